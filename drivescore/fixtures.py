"""The operators' tables as views over a star schema, in SQL that Spark and ANSI engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_tree": """select 'ROOT' as id, cast(null as string) as parent union all select r_name, 'ROOT' from region
        union all select n_name, r_name from nation join region on n_regionkey = r_regionkey""",
    "fx_cohorts": "select s_name as cohort, n_name as ttype from supplier join nation on s_nationkey = n_nationkey",
    "fx_muts": """select s_name as cohort, p_brand as gene, cast(l_linenumber as string) as chr, cast(l_partkey as int) as pos,
        l_linestatus as ref, l_returnflag as alt, cast(l_orderkey as string) as sample_id,
        case cast(l_quantity as int) % 4 when 0 then 'Missense' when 1 then 'Nonsense' when 2 then 'Essential_Splice' else 'Synonymous' end as impact
        from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey""",
    "fx_tmuts": "select m.*, c.ttype from fx_muts m join fx_cohorts c on m.cohort = c.cohort",
    "fx_clusters": """select cast(p_size % 7 + 1 as string) as chr, cast(p_partkey as int) as lo, cast(p_partkey + p_size as int) as hi,
        n_name as ttype, (p_partkey % 100) / cast(1000 as double) as p_value,
        concat(cast(p_partkey as string), ',', cast(p_partkey + p_size as string), ';', cast(p_partkey + 100 as string), ',', cast(p_partkey + 110 as string)) as packed
        from part join nation on p_partkey % 25 = n_nationkey""",
    "fx_domains": """select p_brand as gene, cast(p_partkey as int) as start_pos, cast(p_partkey + p_size as int) as stop_pos, p_name as element,
        n_name as ttype, cast(p_partkey as int) as ord from part join nation on p_partkey % 25 = n_nationkey""",
    "fx_excess": "select p_brand as gene, avg(p_size) / cast(3 as double) as wmis, max(p_size) / cast(4 as double) as wnon, min(p_size) / cast(2 as double) as wspl from part group by p_brand",
    "fx_scored": """select d.doc_id as id, lang as grp, cast(d.doc_id % 5 as int) as split, cast(quality as int) as label, n_chars / cast(n_chars + 4000 as double) as p,
        case when toxic = 1 then null else cast(n_chars as double) end as ext_score from labels l join documents d on l.doc_id = d.doc_id""",
    "fx_samples": "select event_type as ttype, cast(user_id as string) as sample_id, cast(floor(value) as int) as pos, event_id from events",
    "fx_rates": "select p_brand as gene, p_type as context, sum(p_retailprice) as rate from part group by p_brand, p_type",
    "fx_seq": """select cast(p_partkey % 7 + 1 as string) as chr, cast(p_partkey * 100 as int) as start, p_brand as gene,
        translate(lower(concat(p_name, p_type, p_brand)), 'abcdefghijklmnopqrstuvwxyz #0123456789', 'ACGTACGTACGTACGTACGTACGTACNNACGTACGTAC') as seq from part""",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


class Tables:
    """Tables and views of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        register(spark, sf_dir)

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)


def oracle(sql: str) -> str:
    """The query with the views that it names, and those that they name, before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in needed:
                need(body)
                needed.append(name)

    need(sql)
    views = [f"{n} as ({VIEWS[n]})" for n in needed]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join([*views, body[15:]])}"
    if body.lower().startswith("with "):
        return f"with {', '.join([*views, body[5:]])}"
    return (f"with {', '.join(views)} " if views else "") + body
