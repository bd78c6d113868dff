"""Tumor-type tree: closure and the questions that it answers. Edges are (id, parent) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivescore.sources.tables import written


def tree_closure(edges: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """(node, ancestor, depth) for every node and each of its ancestors, itself at depth 0.

    A node that stands only as a parent is a root. A cycle is an error. Paths double: a round knows each node's ancestors below 2^k steps and its
    jump of 2^k, and finds the next 2^k through the jump, so that a tree of depth d takes log2(d) rounds, each written.
    """
    own = edges.select(F.col(id_col).alias("node"), F.col(parent_col).alias("ancestor"))
    jump = written(own.filter("ancestor is not null"), "jumps")
    names = own.select("node").unionByName(jump.select(F.col("ancestor").alias("node"))).filter("node is not null").distinct()
    closure = written(names.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), "closure")
    reach = 1
    while not jump.isEmpty():
        far = jump.select("node", F.col("ancestor").alias("at"))
        above = closure.select(F.col("node").alias("at"), "ancestor", (F.col("depth") + reach).alias("depth"))
        closure = written(closure.unionByName(far.join(above, "at").select("node", "ancestor", "depth")), "closure")
        if not closure.filter("depth > 0 and node = ancestor").isEmpty():
            raise ValueError("the tree has a cycle")
        jump = written(far.join(jump.withColumnRenamed("node", "at"), "at").select("node", "ancestor"), "jumps")
        reach *= 2
    return closure


def subtree_cohorts(closure: DataFrame, cohorts: DataFrame, cohort: str = "cohort", ttype: str = "ttype", node: str | None = None) -> DataFrame:
    """(node, cohort): cohorts of the node or any node below it; of one ``node`` if named, which the tree must have."""
    if node is not None:
        closure = closure.filter(F.col("ancestor") == node)
        if closure.isEmpty():
            raise ValueError(f"unknown tumor type: {node}")
    at = cohorts.select(F.col(cohort).alias("cohort"), F.col(ttype).alias("at"))
    return closure.join(at, closure["node"] == at["at"]).select(F.col("ancestor").alias("node"), "cohort")


def subtree_filter(df: DataFrame, closure: DataFrame, node: str, ttype: str = "ttype") -> DataFrame:
    """Rows whose ttype is the node or lies below it."""
    return df.join(closure.filter(F.col("ancestor") == node).select(F.col("node").alias(ttype)), ttype, "left_semi")


def at_ancestors(df: DataFrame, closure: DataFrame, ttype: str = "ttype") -> DataFrame:
    """Each row once under its ttype and once under each ttype above it, so that equality finds a subtree's rows."""
    above = closure.select(F.col("node").alias(ttype), F.col("ancestor").alias("_above"))
    return df.join(above, ttype).drop(ttype).withColumnRenamed("_above", ttype)


def ancestor_map(closure: DataFrame, name: str) -> DataFrame:
    """One row: a map from each node to its ancestors, itself among them. It is as small as the tree, and lets rows find the nodes above a list of
    theirs without a row for each."""
    lists = closure.groupBy("node").agg(F.collect_set("ancestor").alias("_l"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct("node", "_l"))).alias(name))


def above(name: str, node: Column) -> Column:
    """The node's list in the map; none for NULL and for names that the tree does not have."""
    return F.coalesce(F.element_at(name, node), F.array().cast("array<string>"))


def genes_to_ttypes(df: DataFrame, gene: str = "gene", ttype: str = "ttype") -> DataFrame:
    """(gene, ttypes): the distinct ttypes of each gene, in order."""
    return df.select(gene, ttype).distinct().groupBy(gene).agg(F.sort_array(F.collect_list(ttype)).alias("ttypes"))


def leaves_of(closure: DataFrame) -> DataFrame:
    """(node, leaf): the leaves under each node; a leaf is its own."""
    parents = closure.filter("depth = 1").select(F.col("ancestor").alias("p")).distinct()
    return closure.join(parents, closure["node"] == parents["p"], "left_anti").select(F.col("ancestor").alias("node"), F.col("node").alias("leaf"))


def parent_of(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``nodes`` with their parent; NULL for the root and for names that the tree does not have."""
    named = edges.select(F.col("id").alias("_id"), "parent")
    return nodes.join(named, nodes[node] == named["_id"], "left").drop("_id")


def node_tests(edges: DataFrame, cohorts: DataFrame, cohort: str = "cohort") -> DataFrame:
    """(name, is_parent, is_cohort) of all names: nodes of the tree, and cohorts."""
    parents = edges.filter("parent is not null").select(F.col("parent").alias("name")).distinct()
    own = cohorts.select(F.col(cohort).alias("name")).distinct()
    names = edges.select(F.col("id").alias("name")).union(parents).union(own).distinct()
    out = names.join(parents.withColumn("is_parent", F.lit(True)), "name", "left").join(own.withColumn("is_cohort", F.lit(True)), "name", "left")
    return out.na.fill(False, ["is_parent", "is_cohort"])


def descendants_of(closure: DataFrame) -> DataFrame:
    """(node, descendant, depth) below each node."""
    return closure.filter("depth > 0").select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")


def qualifying_ancestor(closure: DataFrame, evaluated: DataFrame, key: str, farthest: bool = False) -> DataFrame:
    """(ttype, key, selected_ttype): the nearest (or farthest) ancestor whose model of the key qualifies.

    ``evaluated`` has (ttype, key, qualifies). A ttype and key without any takes no part; with
    ``farthest``, it has a NULL instead. An ancestor that was not evaluated does not qualify.
    """
    good = evaluated.filter("qualifies").select(F.col("ttype").alias("anc"), key)
    pairs = closure.join(good, closure["ancestor"] == good["anc"]).select(F.col("node").alias("ttype"), key, "ancestor", "depth")
    pick = F.max_by("ancestor", "depth") if farthest else F.min_by("ancestor", "depth")
    best = pairs.groupBy("ttype", key).agg(pick.alias("selected_ttype"))
    asked = evaluated.select("ttype", key).distinct()
    return asked.join(best, ["ttype", key], "left" if farthest else "inner")


def drivers_of_ttype(closure: DataFrame, cohorts: DataFrame, drivers: DataFrame) -> DataFrame:
    """(cohort, gene): driver genes of any cohort in the subtree of the cohort's ttype."""
    sisters = subtree_cohorts(closure, cohorts).withColumnRenamed("cohort", "sister").withColumnRenamed("node", "ttype")
    named = drivers.select(F.col("cohort").alias("sister"), "gene").distinct()
    # Genes by ttype first: many cohorts share one, so the wide side is not repeated for each.
    genes = sisters.join(named, "sister").select("ttype", "gene").distinct()
    return cohorts.select("cohort", "ttype").distinct().join(genes, "ttype").select("cohort", "gene").distinct()


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
