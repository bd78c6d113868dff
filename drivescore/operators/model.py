"""Ensembles of boosted trees: one model per key and split, trained, scored and explained.

Models are node rows, so that they are stored, joined and compared like any table. Training is that of ``boosting``, which deals large
keys over tasks; scoring and explaining deal a key's rows over tasks, each of which has the key's compiled models (``forest``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivescore.operators.boosting import boosted_nodes, fit_booster, matrix, sigmoid, spread
from drivescore.operators.forest import Forest, tree_shapley, tree_values

__all__ = ["fit_booster", "tree_values"]
NODE_COLUMNS = "tree int, node int, feature int, threshold double, left_node int, right_node int, value double, cover double, base_margin double"
TASK_ROWS = 65_536
TASK_MEETS = 262_144
# Parameters of the boosters.
ROUNDS, RATE, PATIENCE, DEPTH = 20_000, 0.001, 2_000, 4


def train_ensemble(df: DataFrame, keys: list[str], features: list[str], row_id: str, label: str = "label", role: str = "role", rounds: int = ROUNDS, rate: float = RATE, patience: int = PATIENCE, depth: int = DEPTH) -> DataFrame:
    """Node rows of one booster per key (keys include the split). Groups without both labels in train give none."""
    return boosted_nodes(df, keys, features, row_id, label, role, rounds, rate, patience, depth).drop("logloss")


def learning_curves(df: DataFrame, keys: list[str], features: list[str], row_id: str, label: str = "label", role: str = "role", rounds: int = ROUNDS, rate: float = RATE, patience: int = PATIENCE, depth: int = DEPTH) -> DataFrame:
    """(keys, round, logloss): test log loss after each round of a key's booster, up to its best round."""
    nodes = boosted_nodes(df, keys, features, row_id, label, role, rounds, rate, patience, depth)
    return nodes.filter("node = 0").select(*keys, F.col("tree").alias("round"), "logloss")


def failed_groups(df: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that gave no model."""
    return df.select(*keys).distinct().join(nodes.select(*keys).distinct(), keys, "left_anti")


def _trees(nodes: pd.DataFrame) -> list[np.ndarray]:
    ordered = nodes.sort_values(["tree", "node"])
    numbers = ordered["tree"].to_numpy()
    return np.split(ordered[["feature", "threshold", "left_node", "right_node", "value", "cover"]].to_numpy(float), np.flatnonzero(numbers[1:] != numbers[:-1]) + 1)


def _members(nodes: pa.Table, member: str | None) -> Iterator[tuple[pa.Scalar | None, float, list[np.ndarray]]]:
    """(name, base margin, trees) of each member of a key, or of its one model. Members without a name are left out."""
    if not len(nodes):
        return
    nodes = nodes.combine_chunks()
    if member:
        nodes = nodes.filter(nodes[member].is_valid())
    codes = nodes[member].combine_chunks().dictionary_encode().indices.to_numpy() if member else np.zeros(len(nodes), np.int64)
    numbers = matrix(nodes, ["feature", "threshold", "left_node", "right_node", "value", "cover"])
    tree, bases = nodes["tree"].to_numpy(), nodes["base_margin"].to_numpy()
    order = np.lexsort((nodes["node"].to_numpy(), tree, codes))
    for own in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []:
        yield (nodes[member][int(own[0])] if member else None), float(bases[own[0]]), np.split(numbers[own], np.flatnonzero(np.diff(tree[own])) + 1)


def dealt(rows: DataFrame, nodes: DataFrame, keys: list[str], row_id: str, salts: int | None = None, member: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both with a column _salt: a key's rows dealt over salts, its nodes once for each of them.

    A key has one salt for each ``TASK_ROWS`` of its rows, so that no task holds a large key whole, and at least ``salts``. If each row
    meets all members of its key, a salt has at most ``TASK_MEETS`` of these pairs, or one row.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    many = F.greatest(F.lit(salts or 1), F.ceil(F.col("_n") / TASK_ROWS))
    if member:
        counts = counts.join(nodes.groupBy(*keys).agg(F.count_distinct(member).alias("_members")), keys, "left")
        many = F.greatest(many, F.least(F.col("_n"), F.ceil(F.col("_n") * F.coalesce("_members", F.lit(1)) / TASK_MEETS)))
    counts = counts.select(*keys, many.cast("int").alias("_salts"))
    rows, nodes = rows.join(counts, keys, "left"), nodes.join(counts, keys, "left")
    many = F.coalesce("_salts", F.lit(1))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), many).cast("int")).drop("_salts")
    right = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_salts")
    return spread(left, *keys, "_salt"), spread(right, *keys, "_salt")


def score_members(df: DataFrame, nodes: DataFrame, keys: list[str], features: list[str], row_id: str, member: str | None = None, salts: int | None = None) -> DataFrame:
    """(keys, member, row id, p): each row's probability under its own model, or under each member of its key.

    With ``member`` the keys find all members' nodes and rows have no member. The rows of a key are dealt
    over tasks, each with the key's nodes; their number follows from the key's rows and members, and is at least ``salts``.
    """

    def score(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        # Keys and ids are handed on as they came, so that a member adds no more than its name and its numbers.
        x, out = matrix(rows, features), []
        for name, base, trees in _members(nodes, member) if len(rows) else []:
            part = rows.select([*keys, row_id]).append_column("p", pa.array(sigmoid(Forest.of(trees, base, len(features)).margins(x))))
            out.append(part.append_column(member, pa.repeat(name, len(rows))).select(names) if member else part)
        return pa.concat_tables(out or [pa.Table.from_arrays([pa.array([], (rows if c in rows.column_names else nodes).schema.field(c).type if c != "p" else pa.float64()) for c in names], names=names)])

    names = [*keys, *([member] if member else []), row_id, "p"]
    left, right = dealt(df.select(*keys, row_id, *[F.col(f).cast("double").alias(f) for f in features]), nodes, keys, row_id, salts, member)
    kind = {k: (df if k in df.columns else nodes).schema[k].dataType.simpleString() for k in [*keys, *([member] if member else []), row_id]}
    schema = ", ".join(f"`{k}` {v}" for k, v in kind.items()) + ", p double"
    return left.groupBy(*keys, "_salt").cogroup(right.groupBy(*keys, "_salt")).applyInArrow(score, schema)


def tree_attribution(df: DataFrame, nodes: DataFrame, keys: list[str], features: list[str], row_id: str, member: str | None = None) -> DataFrame:
    """(keys, member, row id, attr_<feature> ..., base, margin): additive attribution of each row's margin under its model, or under
    each member of its key."""
    own = [member] if member else []
    names = [*keys, *own, row_id, *[f"attr_{f}" for f in features], "base", "margin"]

    def explain(key: tuple, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        found = []
        for name, part in trees.groupby(member, sort=True) if member else [(None, trees)]:
            if len(rows) and len(part):
                x, start = rows[features].to_numpy(float), float(part["base_margin"].iloc[0])
                out, base, own_trees = np.zeros((len(x), len(features))), start, list(_trees(part))
                for t in own_trees:
                    base += tree_shapley(t, x, out)
                margin = Forest.of(own_trees, start, len(features)).margins(x)
                more = {f"attr_{f}": out[:, k] for k, f in enumerate(features)} | ({member: name} if member else {})
                found.append(rows[[*keys, row_id]].assign(**more, base=base, margin=margin)[names])
        return pd.concat(found) if found else pd.DataFrame(columns=names)

    kinds = ", ".join(f"`{k}` {(df if k in df.columns else nodes).schema[k].dataType.simpleString()}" for k in [*keys, *own, row_id])
    schema = f"{kinds}, " + ", ".join(f"attr_{f} double" for f in features) + ", base double, margin double"
    left, right = dealt(df.select(*keys, row_id, *[F.col(f).cast("double").alias(f) for f in features]), nodes, keys, row_id, member=member)
    return left.groupBy(*keys, "_salt").cogroup(right.groupBy(*keys, "_salt")).applyInPandas(explain, schema)


def mean_attribution(attributions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the members' attributions for each row."""
    names = [c for c in attributions.columns if c.startswith("attr_")]
    return attributions.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])


def select_model(genes: DataFrame, selection: DataFrame, root: str | None = None) -> DataFrame:
    """(ttype, gene, selected_ttype): the chosen model; with ``root``, genes without one take the root's."""
    if root is None:
        return genes.join(selection, ["ttype", "gene"])
    return genes.join(selection, ["ttype", "gene"], "left").withColumn("selected_ttype", F.coalesce("selected_ttype", F.lit(root)))
