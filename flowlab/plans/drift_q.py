"""Registered drift / novelty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import drift as D
from flowlab.plans import finish, query, rounded
from flowlab.plans.sql import FLOWS, NUMERIC, SCORED, with_
from flowlab.sources.tables import FAMILIES, FLOW_CATEGORICAL, FLOW_NUMERIC, flows, scored


def _drift_sql() -> str:
    parts = [f"""SELECT '{c}' AS feature, avg(CASE WHEN split='train' THEN {c} END) AS train_mean,
  avg(CASE WHEN split='test' THEN {c} END) AS test_mean, stddev_pop(CASE WHEN split='train' THEN {c} END) AS train_std FROM flows"""
             for c in NUMERIC]
    return with_(FLOWS, "m AS (" + "\nUNION ALL\n".join(parts) + ")") + """
SELECT *, CASE WHEN train_std > 0 THEN abs(test_mean - train_mean) / train_std ELSE 0.0 END AS abs_standardized_mean_shift FROM m"""


@query("a16_numeric_drift", rounded(_drift_sql(), "train_mean", "test_mean", "train_std",
                                    "abs_standardized_mean_shift"))
def a16_numeric_drift(spark, sf):
    return finish(D.numeric_drift(flows(spark, sf), FLOW_NUMERIC))


def _shares_sql(cols) -> str:
    parts = [f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, split FROM flows" for c in cols]
    return with_(FLOWS, "l AS (" + "\nUNION ALL\n".join(parts) + ")",
                 """c AS (SELECT feature, value, split, count(*) AS n FROM l WHERE value IS NOT NULL
  AND split IN ('train','test') GROUP BY ALL)""",
                 """s AS (SELECT *, n / sum(n) OVER (PARTITION BY feature, split) AS share FROM c)""",
                 """vs AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.value, b.value) AS value,
  coalesce(a.share, 0.0) AS train_share, coalesce(b.share, 0.0) AS test_share
  FROM (SELECT * FROM s WHERE split='train') a FULL OUTER JOIN (SELECT * FROM s WHERE split='test') b
  ON a.feature = b.feature AND a.value = b.value)""")


@query("j05_outer_align", rounded(_shares_sql(FLOW_CATEGORICAL) + "SELECT * FROM vs",
                                  "train_share", "test_share"))
def j05_outer_align(spark, sf):
    return finish(D.value_shares(flows(spark, sf), FLOW_CATEGORICAL))


@query("a17_categorical_drift", rounded(_shares_sql(FLOW_CATEGORICAL) + """,
d AS (SELECT *, test_share - train_share AS diff FROM vs),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(diff) DESC, value) AS rk FROM d)
SELECT feature, CAST(sum((train_share > 0)::INT) AS BIGINT) AS train_unique,
  CAST(sum((test_share > 0)::INT) AS BIGINT) AS test_unique,
  CAST(sum((test_share > 0 AND train_share = 0)::INT) AS BIGINT) AS test_only_values,
  sum(abs(diff)) * 0.5 AS total_variation_distance,
  string_agg(CASE WHEN rk <= 3 THEN value || ': ' || printf('%+.1f', diff * 100) || 'pp' END, ', ' ORDER BY rk)
    AS largest_category_shifts
FROM r GROUP BY feature""", "total_variation_distance"))
def a17_categorical_drift(spark, sf):
    return finish(D.categorical_drift(flows(spark, sf), FLOW_CATEGORICAL))


@query("a18_class_mix_shift", rounded(_shares_sql(["attack_family"]) + """
SELECT CAST(d.i - 1 AS INT) AS class_order, d.v AS attack_family, coalesce(vs.train_share, 0.0) AS train_share,
  coalesce(vs.test_share, 0.0) AS test_share,
  (coalesce(vs.test_share, 0.0) - coalesce(vs.train_share, 0.0)) * 100 AS test_minus_train_pp
FROM (SELECT unnest(['normal','DoS','Probe','R2L','U2R']) AS v, unnest(range(1, 6)) AS i) d
LEFT JOIN vs ON vs.value = d.v""", "train_share", "test_share", "test_minus_train_pp"))
def a18_class_mix_shift(spark, sf):
    return finish(D.class_mix_shift(flows(spark, sf), "attack_family", FAMILIES))


# The splits are cut by time, so the labels that a tenth of the users get, with the day in them, are in one split only.
@query("j03_unseen_labels", with_(SCORED, """d AS (SELECT split, CASE WHEN user_id % 10 = 0 THEN label || strftime(ts, '@%d') ELSE label END AS label FROM scored)""",
                                  "a AS (SELECT DISTINCT label FROM d WHERE split='train')",
                                  "b AS (SELECT DISTINCT label FROM d WHERE split='test')") + """
SELECT 'test_only' AS direction, label FROM b WHERE label NOT IN (SELECT label FROM a)
UNION ALL SELECT 'train_only' AS direction, label FROM a WHERE label NOT IN (SELECT label FROM b)""")
def j03_unseen_labels(spark, sf):
    dated = F.concat("label", F.date_format("ts", "'@'dd"))
    return D.unseen_labels(scored(spark, sf).withColumn("label", F.when(F.col("user_id") % 10 == 0, dated).otherwise(F.col("label"))))


@query("j04_unseen_categories", _shares_sql(FLOW_CATEGORICAL) + """
SELECT d.feature, CAST(count(vs.value) AS BIGINT) AS test_only_values
FROM (SELECT unnest(['protocol_type','service','flag']) AS feature) d
LEFT JOIN vs ON vs.feature = d.feature AND vs.train_share = 0 AND vs.test_share > 0
GROUP BY d.feature""")
def j04_unseen_categories(spark, sf):
    return D.unseen_categories(flows(spark, sf), FLOW_CATEGORICAL)


@query("u04_distinct_union", with_(FLOWS) + """
SELECT flag FROM flows WHERE split='train' UNION SELECT flag FROM flows WHERE split='test'""")
def u04_distinct_union(spark, sf):
    return D.distinct_union(flows(spark, sf), "flag")
