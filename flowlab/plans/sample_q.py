"""Registered sampling / splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import sample as S
from flowlab.plans import query
from flowlab.plans.sql import SCORED, with_
from flowlab.sources.tables import scored

H0 = "((row_key % 2147483647) * 48271) % 2147483647"
H1 = f"((({H0}) % 2147483647) * 48271) % 2147483647"


def _ranked_sql(by: str, h: str = H0) -> str:
    return with_(SCORED, f"""c AS (SELECT {by} AS cls, count(*) AS nc, sum(count(*)) OVER () AS n FROM scored GROUP BY {by})""",
                 f"""r AS (SELECT row_key, {by} AS cls, row_number() OVER (PARTITION BY {by} ORDER BY {h}, row_key) AS rk
  FROM scored)""")


def _cap_sql(by: str, max_rows: int, seed_h: str = H0, trim_h: str = H1) -> str:
    return _ranked_sql(by, seed_h) + f""",
q AS (SELECT cls, least(nc, greatest(1, CAST(round_even({max_rows} * nc / n, 0) AS BIGINT))) AS quota FROM c),
p AS (SELECT r.row_key, r.cls FROM r JOIN q USING (cls) WHERE r.rk <= q.quota),
t AS (SELECT *, row_number() OVER (ORDER BY {trim_h.replace('row_key', 'p.row_key')}, p.row_key) AS g FROM p)
SELECT row_key, cls AS {by} FROM t WHERE g <= {max_rows}"""


@query("d01_stratified_cap", _cap_sql("attack_family", 1000))
def d01_stratified_cap(spark, sf):
    return S.stratified_cap(scored(spark, sf), "attack_family", "row_key", 1000).select(
        "row_key", "attack_family")


@query("d05_stratified_subsample", _cap_sql("label", 777))
def d05_stratified_subsample(spark, sf):
    return S.stratified_cap(scored(spark, sf), "label", "row_key", 777).select("row_key", "label")


@query("d02_label_budget", _ranked_sql("attack_family") + """,
q AS (SELECT cls, least(nc, greatest(1, CAST(round_even(nc * 0.05, 0) AS BIGINT))) AS quota FROM c)
SELECT r.row_key, r.cls AS attack_family FROM r JOIN q USING (cls) WHERE r.rk <= q.quota""")
def d02_label_budget(spark, sf):
    return S.label_budget(scored(spark, sf), "attack_family", "row_key", 0.05).select(
        "row_key", "attack_family")


D03_SQL = _ranked_sql("attack_family") + """,
q AS (SELECT cls, CAST(round_even(nc * 0.2, 0) AS BIGINT) AS quota FROM c)
SELECT r.row_key, r.cls AS attack_family, CASE WHEN r.rk <= q.quota THEN 'validation' ELSE 'train' END AS role
FROM r JOIN q USING (cls)"""


@query("d03_stratified_split", D03_SQL)
def d03_stratified_split(spark, sf):
    return S.stratified_split(scored(spark, sf), "attack_family", "row_key", 0.2).select(
        "row_key", "attack_family", "role")


@query("d04_uniform_cap", with_(SCORED) + f"SELECT row_key, label FROM scored ORDER BY {H0}, row_key LIMIT 500")
def d04_uniform_cap(spark, sf):
    return S.uniform_cap(scored(spark, sf), "row_key", 500).select("row_key", "label")


@query("d06_stratified_folds", _ranked_sql("attack_family") + """
SELECT cls AS attack_family, CAST((rk - 1) % 3 AS INT) AS fold, count(*) AS n FROM r GROUP BY ALL""")
def d06_stratified_folds(spark, sf):
    f = S.stratified_folds(scored(spark, sf), "attack_family", "row_key", 3)
    return f.groupBy("attack_family", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("d07_first_n", with_(SCORED) + "SELECT row_key, label, score FROM scored ORDER BY ts, row_key LIMIT 100")
def d07_first_n(spark, sf):
    return S.first_n(scored(spark, sf), ["ts", "row_key"], 100).select("row_key", "label", "score")


@query("w05_chunk_ids", with_(SCORED) + """
SELECT row_key, CAST(floor((row_number() OVER (ORDER BY row_key) - 1) / 1000) AS BIGINT) AS chunk_id FROM scored""")
def w05_chunk_ids(spark, sf):
    return S.chunk_ids(scored(spark, sf), "row_key", 1000).select("row_key", "chunk_id")
