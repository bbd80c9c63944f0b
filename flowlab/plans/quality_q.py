"""Registered data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import quality as Q
from flowlab.plans import finish, query, rounded
from flowlab.plans.sql import FLOWS, NUMERIC, SCORED, with_
from flowlab.sources.tables import FAMILIES, FLOW_CATEGORICAL, FLOW_NUMERIC, flows, scored

FEATURES = FLOW_CATEGORICAL + FLOW_NUMERIC


@query("a01_class_counts", rounded(with_(FLOWS, """c AS (SELECT attack_family, count(*) AS n FROM flows GROUP BY ALL)""") + """
SELECT CAST(d.i - 1 AS INT) AS class_order, d.attack_family, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER () AS share
FROM (SELECT unnest(['normal','DoS','Probe','R2L','U2R']) AS attack_family, unnest(range(1, 6)) AS i) d
LEFT JOIN c USING (attack_family)""", "share"))
def a01_class_counts(spark, sf):
    return finish(Q.class_counts(flows(spark, sf), "attack_family", FAMILIES))


@query("a02_phase1_summary", with_(FLOWS) + f"""
SELECT count(*) AS rows, {len(FEATURES)} AS n_features, count(DISTINCT label) AS n_fine_labels,
  count(DISTINCT CASE WHEN attack_family IN ('normal','DoS','Probe','R2L','U2R') THEN attack_family END) AS n_categories
FROM flows""")
def a02_phase1_summary(spark, sf):
    return Q.phase1_summary(flows(spark, sf), FEATURES, "label", "attack_family", FAMILIES)


# Defects are injected deterministically into the whole events table (a
# null every 97th key, +Inf every 101st, a near-constant and a constant
# column, a wrong binary label every 89th, and every 50th row repeated) so
# each audit counter is non-zero.
AUDIT_COLS = ["value", "f_null", "f_inf", "f_near", "f_const"]


def audited(spark, sf):
    s = scored(spark, sf)
    k = F.col("row_key")
    base = s.select(
        "row_key", "label", F.col("attack_family").alias("attack_category"), "y",
        F.col("score").alias("value"),
        F.when(k % 97 == 0, F.lit(None).cast("double")).otherwise(F.col("score")).alias("f_null"),
        F.when(k % 101 == 0, F.lit(float("inf"))).otherwise(F.col("score")).alias("f_inf"),
        F.when(k % 5000 == 0, 1.0).otherwise(0.0).alias("f_near"),
        F.lit(0.0).alias("f_const"))
    right = F.when(F.col("attack_category") == "normal", 0).otherwise(F.col("y"))
    base = base.withColumn("binary_label", F.when(k % 89 == 0, 1 - right).otherwise(right).cast("int")).drop("y")
    return base.unionByName(base.where(k % 50 == 0))


AUDITED_SQL = SCORED + """,
base AS (SELECT row_key, label, attack_family AS attack_category, score AS value,
  CASE WHEN row_key % 97 = 0 THEN NULL ELSE score END AS f_null,
  CASE WHEN row_key % 101 = 0 THEN 'Infinity'::DOUBLE ELSE score END AS f_inf,
  CASE WHEN row_key % 5000 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_near,
  0.0::DOUBLE AS f_const,
  CAST(abs((row_key % 89 = 0)::INT - CASE WHEN attack_family = 'normal' THEN 0 ELSE y END) AS INT) AS binary_label FROM scored),
audited AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE row_key % 50 = 0)"""


def _colq_sql() -> str:
    parts = []
    for c in AUDIT_COLS:
        parts.append(f"""SELECT '{c}' AS feature, CAST(sum(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  CAST(sum(CASE WHEN isinf({c}) THEN 1 ELSE 0 END) AS BIGINT) AS inf,
  count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 AS is_constant,
  (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 1) AND
    (SELECT max(n) FROM (SELECT count(*) AS n FROM audited WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) > 0.999 AS is_near_constant,
  CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM audited WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) > 0.999
    THEN (SELECT max(n) FROM (SELECT count(*) AS n FROM audited WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) END AS dominant_share
FROM audited""")
    return "\nUNION ALL\n".join(parts)


@query("a13_column_quality", rounded(with_(AUDITED_SQL) + _colq_sql(), "dominant_share"))
def a13_column_quality(spark, sf):
    return finish(Q.column_quality(audited(spark, sf), AUDIT_COLS))


@query("a13_quality_audit", rounded(with_(AUDITED_SQL, "cq AS (" + _colq_sql() + ")",
                                          """d AS (SELECT count(*) AS c FROM audited GROUP BY row_key, label, attack_category, value, f_null,
  f_inf, f_near, f_const, binary_label)""") + f"""
SELECT (SELECT count(*) FROM audited) AS rows, {len(AUDIT_COLS)} AS features,
  (SELECT CAST(sum(missing) AS BIGINT) FROM cq) AS missing_cells, (SELECT CAST(sum(inf) AS BIGINT) FROM cq) AS inf_cells,
  (SELECT CAST(sum(c - 1) AS BIGINT) FROM d) AS duplicate_rows,
  (SELECT sum(c - 1) FROM d) * 100.0 / (SELECT count(*) FROM audited) AS duplicate_pct,
  (SELECT CAST(sum(is_constant::INT) AS BIGINT) FROM cq) AS constant_features,
  (SELECT CAST(sum(is_near_constant::INT) AS BIGINT) FROM cq) AS near_constant_features,
  (SELECT CAST(sum(((attack_category = 'normal') != (binary_label = 0))::INT) AS BIGINT) FROM audited) AS consistency_mismatches""",
                                  "duplicate_pct"))
def a13_quality_audit(spark, sf):
    return finish(Q.quality_audit(audited(spark, sf), AUDIT_COLS, "attack_category", "binary_label", benign="normal"))


def _profile_sql() -> str:
    parts = [f"""SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min,
  quantile_cont({c}, 0.5)::DOUBLE AS median, max({c})::DOUBLE AS max, avg(({c} IS NULL)::INT::DOUBLE) AS missing_rate FROM flows"""
             for c in NUMERIC]
    return with_(FLOWS) + "\nUNION ALL\n".join(parts)


@query("a14_numeric_profile", rounded(_profile_sql(), "mean", "std", "min", "median", "max",
                                      "missing_rate"))
def a14_numeric_profile(spark, sf):
    return finish(Q.numeric_profile(flows(spark, sf), FLOW_NUMERIC))


def _attr_sql() -> str:
    parts = [f"""SELECT split, '{c}' AS feature, avg(({c} IS NULL)::INT::DOUBLE) AS missing_rate,
  CAST(count(DISTINCT CAST({c} AS VARCHAR)) AS BIGINT) AS "unique" FROM flows GROUP BY split"""
             for c in FLOW_CATEGORICAL + NUMERIC]
    return with_(FLOWS) + "\nUNION ALL\n".join(parts)


@query("a15_attribute_profile", rounded(_attr_sql(), "missing_rate"))
def a15_attribute_profile(spark, sf):
    return finish(Q.attribute_profile(flows(spark, sf), FEATURES))


@query("a29_crosstab", rounded(with_(FLOWS) + """
SELECT protocol_type, CAST(count(*) AS BIGINT) AS rows,
  avg((attack_family = 'normal')::INT::DOUBLE) AS normal, avg((attack_family = 'DoS')::INT::DOUBLE) AS "DoS",
  avg((attack_family = 'Probe')::INT::DOUBLE) AS "Probe", avg((attack_family = 'R2L')::INT::DOUBLE) AS "R2L",
  avg((attack_family = 'U2R')::INT::DOUBLE) AS "U2R"
FROM flows WHERE split = 'train' GROUP BY protocol_type""", "normal", '"DoS"', '"Probe"', '"R2L"', '"U2R"'))
def a29_crosstab(spark, sf):
    f = flows(spark, sf).where(F.col("split") == "train")
    return finish(Q.crosstab_share(f, "protocol_type", "attack_family", FAMILIES).orderBy(
        F.col("rows").desc(), "protocol_type"))
