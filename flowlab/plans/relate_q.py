"""Registered relation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import relate as R
from flowlab.plans import finish, query, rounded
from flowlab.plans.sql import FLOWS, NUMERIC, with_
from flowlab.sources.tables import FLOW_CATEGORICAL, FLOW_NUMERIC, flows


def _union(template: str, cols) -> str:
    return "\nUNION ALL\n".join(template.format(c=c) for c in cols)


@query("a19_class_separation", rounded(with_(FLOWS, "m AS (" + _union(
    """SELECT '{c}' AS feature, avg(CASE WHEN binary_label = 0 THEN {c} END) AS normal_mean,
  avg(CASE WHEN binary_label = 1 THEN {c} END) AS attack_mean,
  var_pop(CASE WHEN binary_label = 0 THEN {c} END) AS v0, var_pop(CASE WHEN binary_label = 1 THEN {c} END) AS v1 FROM flows""",
    NUMERIC) + ")") + """
SELECT feature, normal_mean, attack_mean,
  CASE WHEN sqrt((v0 + v1) / 2) = 0 OR v0 IS NULL OR v1 IS NULL THEN 0.0
       ELSE abs(attack_mean - normal_mean) / sqrt((v0 + v1) / 2) END AS class_separation FROM m""",
    "normal_mean", "attack_mean", "class_separation"))
def a19_class_separation(spark, sf):
    return finish(R.class_separation(flows(spark, sf), FLOW_NUMERIC))


_CRAMER = with_(FLOWS, "l AS (" + _union(
    "SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'nan') AS value, CAST(binary_label AS VARCHAR) AS t FROM flows",
    FLOW_CATEGORICAL) + ")",
    "o AS (SELECT feature, value, t, count(*) AS o FROM l GROUP BY ALL)",
    "rv AS (SELECT feature, value, sum(o) AS rs FROM o GROUP BY ALL)",
    "cv AS (SELECT feature, t, sum(o) AS cs FROM o GROUP BY ALL)",
    "nn AS (SELECT feature, sum(o) AS n, count(DISTINCT value) AS r, count(DISTINCT t) AS k FROM o GROUP BY ALL)",
    # the full grid: every observed value × every observed class of a feature
    """g AS (SELECT rv.feature, rv.value, cv.t, rv.rs, cv.cs FROM rv JOIN cv ON rv.feature = cv.feature)""",
    """chi AS (SELECT g.feature, sum((coalesce(o.o, 0) - g.rs * g.cs / nn.n) ^ 2 / (g.rs * g.cs / nn.n)) AS chi2
  FROM g JOIN nn ON g.feature = nn.feature LEFT JOIN o ON o.feature = g.feature AND o.value = g.value AND o.t = g.t
  GROUP BY g.feature)""",
    """z AS (SELECT nn.feature, n, r, k, greatest(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) AS p2c,
  r - (r - 1) ^ 2 / (n - 1) AS rc, k - (k - 1) ^ 2 / (n - 1) AS kc FROM nn JOIN chi USING (feature))""")


@query("a20_cramers_v", rounded(_CRAMER + """
SELECT feature, CASE WHEN n <= 1 OR least(kc - 1, rc - 1) <= 0 THEN 0.0 ELSE sqrt(p2c / least(kc - 1, rc - 1)) END AS cramers_v
FROM z""", "cramers_v"))
def a20_cramers_v(spark, sf):
    return finish(R.cramers_v(flows(spark, sf), FLOW_CATEGORICAL))


@query("a21_max_category_rate", rounded(with_(FLOWS, "l AS (" + _union(
    "SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'nan') AS value, binary_label FROM flows",
    FLOW_CATEGORICAL) + ")") + """
SELECT feature, max(rate) AS max_category_attack_rate
FROM (SELECT feature, value, avg(binary_label::DOUBLE) AS rate FROM l GROUP BY ALL) GROUP BY feature""",
    "max_category_attack_rate"))
def a21_max_category_rate(spark, sf):
    return finish(R.max_category_rate(flows(spark, sf), FLOW_CATEGORICAL))


_TCORR = with_(FLOWS, "m AS (" + _union(
    """SELECT '{c}' AS feature, covar_pop({c}, binary_label::DOUBLE) AS cv, stddev_pop({c}) AS sx,
  stddev_pop(binary_label::DOUBLE) AS sy FROM flows""", NUMERIC) + ")",
    """r AS (SELECT feature, CASE WHEN sx = 0 OR sy = 0 OR sx IS NULL THEN 0.0 ELSE cv / (sx * sy) END AS target_corr FROM m)""")


@query("a22_target_correlation", rounded(
    _TCORR + "SELECT feature, target_corr, abs(target_corr) AS abs_target_corr FROM r",
    "target_corr", "abs_target_corr"))
def a22_target_correlation(spark, sf):
    return finish(R.target_correlation(flows(spark, sf), FLOW_NUMERIC))


@query("o03_top_target_correlation", rounded(
    _TCORR + "SELECT feature, target_corr, abs(target_corr) AS abs_target_corr FROM r "
             "ORDER BY abs(target_corr) DESC, feature LIMIT 5", "target_corr", "abs_target_corr"))
def o03_top_target_correlation(spark, sf):
    return finish(R.target_correlation(flows(spark, sf), FLOW_NUMERIC).limit(5))


def _pairs_sql(threshold: float) -> str:
    pairs = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]
    body = "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, covar_pop({a}, {b}) AS cv,
  stddev_pop({a}) AS sa, stddev_pop({b}) AS sb FROM flows""" for a, b in pairs)
    return with_(FLOWS, "m AS (" + body + ")", """r AS (SELECT feature_a, feature_b,
  CASE WHEN sa = 0 OR sb = 0 OR sa IS NULL OR sb IS NULL THEN 0.0 ELSE cv / (sa * sb) END AS corr FROM m)""") + \
        f"SELECT feature_a, feature_b, corr, abs(corr) AS abs_corr FROM r WHERE abs(corr) >= {threshold}::DOUBLE"


@query("a23_correlation_pairs", rounded(_pairs_sql(0.95), "corr", "abs_corr"))
def a23_correlation_pairs(spark, sf):
    return finish(R.correlation_pairs(flows(spark, sf), FLOW_NUMERIC, 0.95))


@query("o04_order_by_abs", rounded(_pairs_sql(0.9) + " AND abs(corr) > 0.9 ORDER BY abs(corr) DESC, feature_a, feature_b",
                                   "corr", "abs_corr"))
def o04_order_by_abs(spark, sf):
    pairs = R.correlation_pairs(flows(spark, sf), FLOW_NUMERIC, 0.9).where(F.abs("corr") > 0.9)
    return finish(pairs.orderBy(F.abs("corr").desc(), "feature_a", "feature_b"))
