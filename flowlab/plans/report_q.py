"""Registered consolidation / ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import evaluate as E
from flowlab.operators import outlier as O
from flowlab.operators import report as RP
from flowlab.plans import finish, query, rounded
from flowlab.plans.evaluate_q import scored5
from flowlab.plans.outlier_q import _LONG
from flowlab.plans.sql import EVENT_FEATURES, SCORED, SCORED5, with_
from flowlab.sources.tables import FAMILIES, EVENT_NUMERIC, event_features, scored

# The threshold "methods" compared in the consolidated tables.
METHODS = [("thr_035", 0.35), ("thr_050", 0.5), ("thr_065", 0.65)]


def method_table(spark, sf):
    """Binary metric rows per (split, method), one aggregation over all rows."""
    s = scored(spark, sf)
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.lit(t).alias("t")) for n, t in METHODS]))
    x = s.select("split", "y", "score", m.alias("m")).select(
        "split", "y", F.col("m.method").alias("method"),
        (F.col("score") >= F.col("m.t")).cast("int").alias("yhat"))
    return E.binary_metrics(x, "y", "yhat", by=["split", "method"])


_MT = with_(SCORED, "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t}::DOUBLE)" for n, t in METHODS)
            + ") v(method, t))", """x AS (SELECT s.split, s.y, m.method, (s.score >= m.t)::INT AS yhat FROM scored s, m)""",
            """c AS (SELECT split, method,
  sum(CASE WHEN y = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS tp
  FROM x GROUP BY split, method)""",
            """mt AS (SELECT split, method, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
  (2 * tp / greatest(2 * tp + fp + fn, 1) + 2 * tn / greatest(2 * tn + fp + fn, 1)) / 2 AS macro_f1,
  (2 * tp / greatest(2 * tp + fp + fn, 1) * (tp + fn) + 2 * tn / greatest(2 * tn + fp + fn, 1) * (tn + fp))
    / (tp + tn + fp + fn) AS weighted_f1,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS attack_recall,
  CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS normal_recall,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE
    (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM c)""")


@query("u01_consolidate", rounded(_MT + """,
fam AS (SELECT split, avg(CASE WHEN yhat5 = y5 THEN 1.0 ELSE 0.0 END) AS accuracy FROM (
  SELECT split, yhat5, CASE attack_family WHEN 'normal' THEN 0 WHEN 'DoS' THEN 1 WHEN 'Probe' THEN 2
    WHEN 'R2L' THEN 3 WHEN 'U2R' THEN 4 END AS y5 FROM scored) GROUP BY split)
SELECT 'events' AS dataset, 'binary' AS task, 'threshold' AS track, method, split AS variant,
  'rule' AS comparison_family, accuracy, macro_f1, weighted_f1, attack_recall, normal_recall,
  NULL::VARCHAR AS rare_recall, mcc, 'score' AS features,
  995000.0 * (1 - normal_recall) AS false_alerts_per_day, 995000.0 * (1 - normal_recall) + 5000.0 * attack_recall AS total_alerts_per_day,
  5000.0 * (1 - attack_recall) AS missed_attacks_per_day,
  CASE WHEN 995000.0 * (1 - normal_recall) + 5000.0 * attack_recall = 0 THEN 0.0
       ELSE 5000.0 * attack_recall / (995000.0 * (1 - normal_recall) + 5000.0 * attack_recall) END AS operational_precision,
  'method_table' AS source_file, NULL::VARCHAR AS limitation FROM mt
UNION ALL
SELECT 'events', 'multiclass', 'hash_baseline', 'yhat5', split, 'rule', accuracy, NULL, NULL, NULL, NULL, NULL, NULL,
  NULL, NULL, NULL, NULL, NULL, 'family_table', 'uniform pseudo-random predictions' FROM fam""",
    "accuracy", "macro_f1", "weighted_f1", "attack_recall", "normal_recall", "mcc", "false_alerts_per_day",
    "total_alerts_per_day", "missed_attacks_per_day", "operational_precision"))
def u01_consolidate(spark, sf):
    mt = E.alert_workload(method_table(spark, sf)).withColumn("variant", F.col("split"))
    a = RP.to_common(mt, dataset="events", task="binary", track="threshold", comparison_family="rule",
                     features="score", source_file="method_table")
    s5 = scored5(spark, sf)
    fam = s5.groupBy("split").agg(F.avg((F.col("yhat5") == F.col("y5")).cast("double")).alias("accuracy"))
    b = RP.to_common(fam.withColumn("variant", F.col("split")), dataset="events", task="multiclass",
                     track="hash_baseline", method="yhat5", comparison_family="rule",
                     source_file="family_table", limitation="uniform pseudo-random predictions")
    return finish(RP.consolidate(a, b))


@query("u02_tagged_union", rounded(_MT + """
SELECT 'method_lab' AS source, method || ' / ' || split AS comparison_label, method, split, macro_f1 FROM mt
UNION ALL
SELECT 'family_recall', attack_family, 'yhat', split, avg(CASE WHEN attack_family = 'normal' THEN (yhat = 0)::INT ELSE (yhat = 1)::INT END)::DOUBLE
FROM scored GROUP BY attack_family, split""", "macro_f1"))
def u02_tagged_union(spark, sf):
    mt = method_table(spark, sf).select("method", "split", "macro_f1")
    s = scored(spark, sf)
    hit = F.when(F.col("attack_family") == "normal", F.col("yhat") == 0).otherwise(F.col("yhat") == 1)
    fr = s.groupBy("attack_family", "split").agg(F.avg(hit.cast("double")).alias("macro_f1")) \
        .select(F.lit("yhat").alias("method"), "split", "macro_f1", "attack_family")
    u = RP.tagged_union([("method_lab", mt)], ["method", "split"]).unionByName(
        RP.tagged_union([("family_recall", fr)], ["attack_family"]).drop("attack_family"))
    return finish(u.select("source", "comparison_label", "method", "split", "macro_f1"))


@query("w01_rank_min", rounded(_MT + """
SELECT split, method, macro_f1, CAST(rank() OVER (ORDER BY round(macro_f1, 12) DESC) AS INT) AS macro_f1_rank FROM mt""",
    "macro_f1"))
def w01_rank_min(spark, sf):
    mt = method_table(spark, sf).select("split", "method", F.round("macro_f1", 12).alias("macro_f1"))
    return finish(RP.rank_desc(mt, "macro_f1"))


@query("w02_best_per_split", rounded(_MT + """
SELECT split, method, macro_f1 FROM mt QUALIFY row_number() OVER (PARTITION BY split ORDER BY macro_f1 DESC, method) = 1""",
    "macro_f1"))
def w02_best_per_split(spark, sf):
    mt = method_table(spark, sf).select("split", "method", "macro_f1")
    return finish(RP.best_per_group(mt, "split", "macro_f1", ["method"]))


@query("o01_top_n", rounded(_MT + """
SELECT split, method, mcc FROM mt WHERE mcc IS NOT NULL ORDER BY mcc DESC, split, method LIMIT 4""", "mcc"))
def o01_top_n(spark, sf):
    mt = method_table(spark, sf).select("split", "method", "mcc")
    return finish(RP.top_n(mt, "mcc", 4, tie=["split", "method"]))


@query("o05_leaderboard", rounded(_MT + "SELECT split, method, accuracy FROM mt ORDER BY split, accuracy DESC, method",
                                  "accuracy"))
def o05_leaderboard(spark, sf):
    mt = method_table(spark, sf).select("split", "method", "accuracy")
    return finish(RP.leaderboard(mt, "split", "accuracy", ["method"]))


@query("j09_variant_delta", rounded(_MT + """
SELECT a.split, a.macro_f1 AS macro_f1_thr_035, b.macro_f1 AS macro_f1_thr_065, b.macro_f1 - a.macro_f1 AS macro_f1_delta
FROM mt a JOIN mt b ON a.split = b.split AND a.method = 'thr_035' AND b.method = 'thr_065'""",
    "macro_f1_thr_035", "macro_f1_thr_065", "macro_f1_delta"))
def j09_variant_delta(spark, sf):
    mt = method_table(spark, sf)
    return finish(RP.metric_delta(mt, "split", "method", "thr_035", "thr_065", "macro_f1"))


@query("u05_keep_first", with_(SCORED) + """
SELECT label, attack_family, row_key FROM scored QUALIFY row_number() OVER (PARTITION BY label ORDER BY ts, row_key) = 1""")
def u05_keep_first(spark, sf):
    s = scored(spark, sf).select("label", "attack_family", "row_key", "ts")
    return RP.keep_first(s, ["label"], ["ts", "row_key"]).drop("ts")


@query("j06_family_lookup", with_(SCORED) + """, f AS (SELECT label, attack_family FROM scored
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY ts, row_key) = 1),
top AS (SELECT label, count(*) AS n FROM scored WHERE split = 'train' GROUP BY label)
SELECT top.label, top.n, f.attack_family FROM top JOIN f USING (label)""")
def j06_family_lookup(spark, sf):
    s = scored(spark, sf)
    fam = RP.keep_first(s.select("label", "attack_family", "ts", "row_key"), ["label"], ["ts", "row_key"]) \
        .select("label", "attack_family")
    top = s.where(F.col("split") == "train").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # one row per distinct label: a bounded broadcast side
    return top.join(F.broadcast(fam), "label")


@query("u03_union_scored", rounded(_LONG + """SELECT split, outlier_feature_count, max(max_abs_robust_z) AS max_abs_robust_z, count(*) AS rows
FROM rows_ GROUP BY split, outlier_feature_count""", "max_abs_robust_z"))
def u03_union_scored(spark, sf):
    ef = event_features(spark, sf)
    ref = O.iqr_reference(ef.where(F.col("split") == "train"), EVENT_NUMERIC)
    tr = O.score_rows(ef.where(F.col("split") == "train"), ref, EVENT_NUMERIC)
    te = O.score_rows(ef.where(F.col("split") == "test"), ref, EVENT_NUMERIC)
    return finish(tr.unionByName(te).groupBy("split", "outlier_feature_count").agg(
        F.max("max_abs_robust_z").alias("max_abs_robust_z"), F.count(F.lit(1)).alias("rows")))
