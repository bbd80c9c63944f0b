"""Registered outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import outlier as O
from flowlab.plans import finish, query, rounded
from flowlab.plans.sql import EVENT_FEATURES, EVENT_NUMERIC, FLOWS, NUMERIC, with_
from flowlab.sources.tables import FLOW_NUMERIC, event_features, flows

KEYS = ["row_key"]


def _q_sql(src: str, cols, where: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
  quantile_cont({c}, 0.5) AS median FROM {src} WHERE {where}""" for c in cols)


_FLOW_FENCES = with_(FLOWS, "q AS (" + _q_sql("flows", NUMERIC, "split = 'train'") + ")",
                     """f AS (SELECT *, q3 - q1 AS iqr,
  CASE WHEN q3 - q1 = 0 THEN q1 ELSE q1 - 1.5 * (q3 - q1) END AS lower_fence,
  CASE WHEN q3 - q1 = 0 THEN q3 ELSE q3 + 1.5 * (q3 - q1) END AS upper_fence FROM q)""",
                     "l AS (" + "\nUNION ALL\n".join(
                         f"SELECT '{c}' AS feature, {c} AS x FROM flows WHERE split = 'train'" for c in NUMERIC) + ")")


@query("a24_outlier_rates", rounded(_FLOW_FENCES + """
SELECT f.feature, CASE WHEN f.iqr = 0 THEN 0.0 ELSE avg(((l.x < f.lower_fence) OR (l.x > f.upper_fence))::INT::DOUBLE) END
  AS outlier_rate_iqr, f.q1, f.q3, f.lower_fence, f.upper_fence
FROM f JOIN l ON l.feature = f.feature GROUP BY f.feature, f.iqr, f.q1, f.q3, f.lower_fence, f.upper_fence""",
                                    "outlier_rate_iqr", "q1", "q3", "lower_fence", "upper_fence"))
def a24_outlier_rates(spark, sf):
    tr = flows(spark, sf).where(F.col("split") == "train")
    return finish(O.outlier_rates(tr, FLOW_NUMERIC))


_EV_FENCES = with_(EVENT_FEATURES, "q AS (" + _q_sql("ef", EVENT_NUMERIC, "split = 'train'") + ")",
                   """f AS (SELECT *, q3 - q1 AS iqr,
  CASE WHEN q3 - q1 = 0 THEN q1 ELSE q1 - 1.5 * (q3 - q1) END AS lower_fence,
  CASE WHEN q3 - q1 = 0 THEN q3 ELSE q3 + 1.5 * (q3 - q1) END AS upper_fence FROM q)""")
_FENCE_D = ("q1", "q3", "iqr", "median", "lower_fence", "upper_fence")


@query("a25_iqr_reference", rounded(_EV_FENCES + "SELECT feature, q1, q3, iqr, median, lower_fence, upper_fence FROM f",
                                    *_FENCE_D))
def a25_iqr_reference(spark, sf):
    tr = event_features(spark, sf).where(F.col("split") == "train")
    return finish(O.iqr_reference(tr, EVENT_NUMERIC))


def _scored_rows(spark, sf):
    ef = event_features(spark, sf)
    ref = O.iqr_reference(ef.where(F.col("split") == "train"), EVENT_NUMERIC)
    return O.score_rows(ef, ref, EVENT_NUMERIC)


# long table of hits in SQL: one row per (row, feature) outside the fences
_LONG = _EV_FENCES + ", cells AS (" + "\nUNION ALL\n".join(
    f"SELECT row_key, split, label, attack_family, binary_label, {i} AS idx, '{c}' AS feature, {c} AS value FROM ef"
    for i, c in enumerate(EVENT_NUMERIC)) + """),
hits AS (SELECT c.row_key, c.split, c.label, c.attack_family, c.binary_label, c.idx, c.feature, c.value,
  f.lower_fence, f.upper_fence,
  CASE WHEN f.iqr = 0 THEN abs(c.value - f.median) ELSE abs(c.value - f.median) / f.iqr END AS abs_robust_z
  FROM cells c JOIN f ON c.feature = f.feature WHERE c.value < f.lower_fence OR c.value > f.upper_fence),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY abs_robust_z DESC, idx DESC) AS rk FROM hits),
per AS (SELECT row_key, count(*) AS cnt, max(abs_robust_z) AS mz,
  string_agg(CASE WHEN rk <= 8 THEN feature END, ', ' ORDER BY rk) AS tops FROM ranked GROUP BY row_key),
rows_ AS (SELECT ef.row_key, ef.split, ef.label, ef.attack_family, ef.binary_label,
  CAST(coalesce(per.cnt, 0) AS INT) AS outlier_feature_count, coalesce(per.cnt, 0) / 3.0 AS outlier_feature_fraction,
  coalesce(per.mz, 0.0) AS max_abs_robust_z, coalesce(per.tops, '') AS top_outlier_features
  FROM ef LEFT JOIN per USING (row_key))
"""
_ROW_D = ("outlier_feature_fraction", "max_abs_robust_z")
_ROW_COLS = ["row_key", "split", "label", "attack_family", "binary_label", "outlier_feature_count",
             "outlier_feature_fraction", "max_abs_robust_z", "top_outlier_features"]


@query("a26_outlier_rows", rounded(_LONG + "SELECT * FROM rows_", *_ROW_D))
def a26_outlier_rows(spark, sf):
    return finish(_scored_rows(spark, sf).select(*_ROW_COLS))


@query("a27_hit_table", rounded(_LONG + """SELECT row_key, split, label, attack_family, feature, value,
  lower_fence, upper_fence, abs_robust_z FROM hits""", "value", "lower_fence", "upper_fence", "abs_robust_z"))
def a27_hit_table(spark, sf):
    return finish(O.hit_table(_scored_rows(spark, sf), ["row_key", "split", "label", "attack_family"]))


@query("a28_feature_frequency", rounded(_LONG + """SELECT split, feature, count(*) AS outlier_rows,
  avg(abs_robust_z) AS mean_abs_robust_z FROM hits GROUP BY ALL""", "mean_abs_robust_z"))
def a28_feature_frequency(spark, sf):
    long = O.hit_table(_scored_rows(spark, sf), ["row_key", "split"])
    return finish(O.feature_frequency(long))


@query("a36_hit_histogram", rounded(_LONG + """SELECT binary_label AS class, outlier_feature_count,
  count(*) AS rows, count(*) / sum(count(*)) OVER (PARTITION BY binary_label) AS density
FROM rows_ GROUP BY binary_label, outlier_feature_count""", "density"))
def a36_hit_histogram(spark, sf):
    return finish(O.hit_histogram(_scored_rows(spark, sf)))


@query("o02_top_outlier_rows", rounded(_LONG + """SELECT * FROM rows_
ORDER BY outlier_feature_count DESC, max_abs_robust_z DESC, row_key LIMIT 30""", *_ROW_D))
def o02_top_outlier_rows(spark, sf):
    return finish(O.top_rows(_scored_rows(spark, sf).select(*_ROW_COLS), KEYS, 30))


@query("w03_first_n_per_split", rounded(_LONG + """SELECT *, CAST(row_number() OVER (PARTITION BY split
  ORDER BY outlier_feature_count DESC, max_abs_robust_z DESC, row_key) AS INT) AS rank_in_group FROM rows_
QUALIFY rank_in_group <= 12""", *_ROW_D))
def w03_first_n_per_split(spark, sf):
    rows = _scored_rows(spark, sf).select(*_ROW_COLS)
    return finish(O.first_n_per_group(rows, "split", [F.col("outlier_feature_count").desc(),
                                                      F.col("max_abs_robust_z").desc(), "row_key"], 12))


_TOP40 = """top AS (SELECT row_key FROM rows_ ORDER BY outlier_feature_count DESC, max_abs_robust_z DESC, row_key LIMIT 40)"""


@query("j01_top_row_hits", rounded(_LONG + ", " + _TOP40 + """
SELECT h.row_key, h.feature, h.abs_robust_z FROM hits h JOIN top t ON h.row_key = t.row_key""", "abs_robust_z"))
def j01_top_row_hits(spark, sf):
    sr = _scored_rows(spark, sf)
    top = O.top_rows(sr, KEYS, 40).select(*KEYS)
    long = O.hit_table(sr, KEYS)
    return finish(long.join(F.broadcast(top), KEYS, "inner").select("row_key", "feature", "abs_robust_z"))


@query("j02_semi_top_features", rounded(_LONG + """,
common AS (SELECT feature FROM hits GROUP BY feature ORDER BY count(*) DESC, feature LIMIT 2)
SELECT row_key, feature, abs_robust_z FROM hits WHERE feature IN (SELECT feature FROM common)""", "abs_robust_z"))
def j02_semi_top_features(spark, sf):
    long = O.hit_table(_scored_rows(spark, sf), KEYS)
    common = (long.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
              .orderBy(F.col("_n").desc(), "feature").limit(2).select("feature"))
    return finish(long.join(F.broadcast(common), "feature", "left_semi")
                  .select("row_key", "feature", "abs_robust_z"))


@query("a30_top_row_heatmap", rounded(_LONG + f""", top AS (SELECT {', '.join(KEYS)} FROM rows_
  ORDER BY outlier_feature_count DESC, max_abs_robust_z DESC, {', '.join(KEYS)} LIMIT 40)
SELECT {', '.join('t.' + k for k in KEYS)}, ln(1 + coalesce(max(CASE WHEN h.feature = 'value' THEN h.abs_robust_z END), 0.0)) AS value
FROM top t LEFT JOIN hits h ON {' AND '.join(f't.{k} = h.{k}' for k in KEYS)} GROUP BY {', '.join('t.' + k for k in KEYS)}""", "value"))  # the other two features have no outliers
def a30_top_row_heatmap(spark, sf):
    return finish(O.top_row_heatmap(_scored_rows(spark, sf), KEYS, 40, 25))
