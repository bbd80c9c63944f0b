"""Registered evaluation queries over the ``scored`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import evaluate as E
from flowlab.operators.label import FAMILY_ORDER, encode_expr, threshold_predict
from flowlab.plans import finish, query, rounded
from flowlab.plans.sql import FAMILY_LIST, SCORED, SCORED5, with_
from flowlab.sources.tables import scored

BIN = ["normal", "attack"]


def scored5(spark, sf):
    s = scored(spark, sf)
    return s.withColumn("y5", encode_expr(F.col("attack_family"), FAMILY_ORDER))


def _cm5_sql() -> str:
    return with_(SCORED5, """grid AS (SELECT CAST(a.range AS INT) AS y_true, CAST(b.range AS INT) AS y_pred
  FROM range(5) a, range(5) b)""", """c AS (SELECT y5 AS y_true, yhat5 AS y_pred, count(*) AS n
  FROM scored5 GROUP BY ALL)""", """cm AS (SELECT g.y_true, g.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM grid g LEFT JOIN c USING (y_true, y_pred))""")


@query("a03_confusion", rounded(_cm5_sql() + f"""
SELECT y_true, y_pred, {FAMILY_LIST}[y_true + 1] AS true_class, {FAMILY_LIST}[y_pred + 1] AS pred_class,
  n, n / greatest(sum(n) OVER (PARTITION BY y_true), 1) AS rate FROM cm""", "rate"))
def a03_confusion(spark, sf):
    return finish(E.confusion(scored5(spark, sf), FAMILY_ORDER, "y5", "yhat5"))


_STATS5 = _cm5_sql() + f""", st AS (
SELECT t.y_true AS class_index, {FAMILY_LIST}[t.y_true + 1] AS class_name,
  CAST(sum(CASE WHEN t.y_true = t.y_pred THEN t.n ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(t.n) AS BIGINT) AS support,
  CAST((SELECT sum(n) FROM cm p WHERE p.y_pred = t.y_true) AS BIGINT) AS predicted
FROM cm t GROUP BY t.y_true),
pc AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM st)
"""


@query("a04_per_class", rounded(_STATS5 + "SELECT * FROM pc", "precision", "recall", "f1"))
def a04_per_class(spark, sf):
    return finish(E.class_stats(scored5(spark, sf), FAMILY_ORDER, "y5", "yhat5"))


_BUNDLE_COLS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1",
                "balanced_accuracy", "mcc")


def _bundle_sql(where: str = "") -> str:
    return _STATS5 + f""", f AS (SELECT * FROM pc {where})
SELECT sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision,
  avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
  avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy,
  (sum(tp) * sum(support)::DOUBLE - sum(support::DOUBLE * predicted))
    / sqrt((sum(support)::DOUBLE ^ 2 - sum(predicted::DOUBLE ^ 2)) * (sum(support)::DOUBLE ^ 2 - sum(support::DOUBLE ^ 2))) AS mcc
FROM f"""


@query("a04_metrics", rounded(_bundle_sql(), *_BUNDLE_COLS))
def a04_metrics(spark, sf):
    return finish(E.metric_bundle(scored5(spark, sf), FAMILY_ORDER, "y5", "yhat5"))


@query("a12_balanced_mcc", rounded(
    "SELECT balanced_accuracy, mcc FROM (" + _bundle_sql() + ") b", "balanced_accuracy", "mcc"))
def a12_balanced_mcc(spark, sf):
    return finish(E.metric_bundle(scored5(spark, sf), FAMILY_ORDER, "y5", "yhat5")
                  .select("balanced_accuracy", "mcc"))


# Macro over labels present only.  Restricting to rows predicted 0..2
# leaves classes 3 and 4 present in truth but never predicted; on the
# train-split normals-and-DoS rows only two classes are present at all.
_A07_SQL = with_(SCORED5, """r AS (SELECT y5 AS y_true, yhat5 AS y_pred FROM scored5
  WHERE split = 'train' AND y5 <= 1 AND yhat5 <= 2)""", """grid AS (SELECT CAST(a.range AS INT) AS y_true,
  CAST(b.range AS INT) AS y_pred FROM range(5) a, range(5) b)""", """c AS (SELECT y_true, y_pred, count(*) AS n
  FROM r GROUP BY ALL)""", """cm AS (SELECT g.y_true, g.y_pred, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN c USING (y_true, y_pred))""",
                 """st AS (SELECT t.y_true AS k, sum(CASE WHEN t.y_true = t.y_pred THEN t.n ELSE 0 END) AS tp,
  sum(t.n) AS support, (SELECT sum(n) FROM cm p WHERE p.y_pred = t.y_true) AS predicted FROM cm t GROUP BY t.y_true)""",
                 """pc AS (SELECT *, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM st)""") + \
    "SELECT sum(tp) / sum(support) AS accuracy, " \
    "avg(CASE WHEN support > 0 OR predicted > 0 THEN f1 END) AS macro_f1, " \
    "sum(f1 * support) / sum(support) AS weighted_f1, " + ", ".join(
        f"max(CASE WHEN k = {i} THEN recall END) AS \"recall:{c}\", "
        f"max(CASE WHEN k = {i} THEN f1 END) AS \"f1:{c}\", "
        f"CAST(max(CASE WHEN k = {i} THEN support END) AS BIGINT) AS \"support:{c}\""
        for i, c in enumerate(FAMILY_ORDER)) + " FROM pc"


def _a07_pred(spark, sf):
    return scored5(spark, sf).where((F.col("split") == "train") & (F.col("y5") <= 1)
                                    & (F.col("yhat5") <= 2))


@query("a07_metric_row", rounded(_A07_SQL, "accuracy", "macro_f1", "weighted_f1",
                                  *[f'"{m}:{c}"' for c in FAMILY_ORDER for m in ("recall", "f1")]))
def a07_metric_row(spark, sf):
    return finish(E.metric_row(_a07_pred(spark, sf), FAMILY_ORDER, "y5", "yhat5"))


@query("a08_rare_recall", rounded(
    "SELECT (\"recall:R2L\" + \"recall:U2R\") / 2 AS rare_recall_mean FROM (" + with_(
        SCORED5, """st AS (SELECT y5, avg(CASE WHEN yhat5 = y5 THEN 1.0 ELSE 0.0 END) AS recall
  FROM scored5 GROUP BY y5)""") + """SELECT max(CASE WHEN y5 = 3 THEN recall END) AS "recall:R2L",
  max(CASE WHEN y5 = 4 THEN recall END) AS "recall:U2R" FROM st) q""", "rare_recall_mean"))
def a08_rare_recall(spark, sf):
    row = E.metric_row(scored5(spark, sf), FAMILY_ORDER, "y5", "yhat5")
    return finish(E.rare_recall_mean(row, ["R2L", "U2R"]))


@query("a05_auc", rounded(with_(SCORED, """st AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM scored GROUP BY score)""",
                                """cu AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp,
  sum(n) OVER (ORDER BY score DESC) AS cn FROM st)""") + """
SELECT sum(n * (cp - p / 2.0)) / (sum(p)::DOUBLE * sum(n)) AS roc_auc,
  sum(CASE WHEN p > 0 THEN p * cp / (cp + cn) END) / sum(p) AS pr_auc FROM cu""", "roc_auc", "pr_auc"))
def a05_auc(spark, sf):
    return finish(E.binary_auc(scored(spark, sf), "score", "y"))


@query("a06_curve", rounded(with_(SCORED, """st AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM scored GROUP BY score)""",
                                  """cu AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp,
  sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS tp_all, sum(n) OVER () AS tn_all FROM st)""") + """
SELECT score AS threshold, CAST(cp AS BIGINT) AS tp, CAST(cn AS BIGINT) AS fp,
  CASE WHEN tn_all = 0 THEN 0.0 ELSE cn / tn_all END AS fpr,
  CASE WHEN tp_all = 0 THEN 0.0 ELSE cp / tp_all END AS tpr,
  CASE WHEN cp + cn = 0 THEN 0.0 ELSE cp / (cp + cn) END AS precision,
  tp_all / (tp_all + tn_all) AS prevalence FROM cu""", "threshold", "fpr", "tpr", "precision", "prevalence"))
def a06_curve(spark, sf):
    return finish(E.curve_points(scored(spark, sf), "score", "y"))


_A09_COLS = ("accuracy", "balanced_accuracy", "precision_attack", "macro_precision", "macro_f1",
             "weighted_f1", "normal_recall", "attack_recall", "mcc", "false_positive_rate",
             "false_negative_rate", "fp_per_10k_benign", "fn_per_10k_attack")


@query("a09_binary_row", rounded(with_(SCORED, """c AS (SELECT
  CAST(sum(CASE WHEN y = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM scored)""") + """
SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy,
  (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
  tp / (tp + fp) AS precision_attack,
  (tp / (tp + fp) + tn / (tn + fn)) / 2 AS macro_precision,
  (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 AS macro_f1,
  (2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / (tp + tn + fp + fn) AS weighted_f1,
  tn / (tn + fp) AS normal_recall, tp / (tp + fn) AS attack_recall,
  (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc,
  tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive,
  fp / greatest(fp + tn, 1) AS false_positive_rate, fn / greatest(fn + tp, 1) AS false_negative_rate,
  fp / greatest(fp + tn, 1) * 10000 AS fp_per_10k_benign, fn / greatest(fn + tp, 1) * 10000 AS fn_per_10k_attack
FROM c""", *_A09_COLS))
def a09_binary_row(spark, sf):
    return finish(E.binary_metrics(scored(spark, sf), "y", "yhat"))


@query("a10_fp_per_10k", rounded(with_(SCORED) + """
SELECT CASE WHEN sum(1 - y) = 0 THEN 0.0 ELSE sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) * 10000.0 / sum(1 - y) END
  AS fp_per_10k_benign FROM scored""", "fp_per_10k_benign"))
def a10_fp_per_10k(spark, sf):
    return finish(E.fp_per_10k_benign(scored(spark, sf), "y", "yhat"))


@query("a11_family_recall", rounded(with_(SCORED) + f"""
SELECT CAST(d.i - 1 AS INT) AS family_order, d.family,
  coalesce(avg(CASE WHEN s.attack_family = 'normal' THEN (s.yhat = 0)::INT ELSE (s.yhat = 1)::INT END), 0.0) AS recall,
  CAST(count(s.row_key) AS BIGINT) AS rows
FROM (SELECT unnest({FAMILY_LIST}) AS family, unnest(range(1, 6)) AS i) d
LEFT JOIN scored s ON s.attack_family = d.family GROUP BY d.i, d.family""", "recall"))
def a11_family_recall(spark, sf):
    return finish(E.family_recall(scored(spark, sf), FAMILY_ORDER, "attack_family", "yhat"))


_SWEEP_SQL = with_(SCORED, """v AS (SELECT y, score FROM scored WHERE split = 'train')""",
                   """t AS (SELECT CAST(i - 5 AS INT) AS position, i / 100.0::DOUBLE AS threshold FROM range(5, 96) r(i))""",
                   """c AS (SELECT t.position, t.threshold,
  CAST(sum(CASE WHEN v.score >= t.threshold AND v.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN v.score >= t.threshold AND v.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN v.score < t.threshold AND v.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN v.score < t.threshold AND v.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM t, v GROUP BY t.position, t.threshold)""",
                   """s AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM c)""",
                   """f AS (SELECT *, 5 * precision * recall / greatest(4 * precision + recall, 1e-12) AS score FROM s)""")
_SWEEP_D = ("threshold", "precision", "recall", "score")


def _sweep(spark, sf):
    s = scored(spark, sf).where(F.col("split") == "train")
    return E.threshold_sweep(s, beta=2.0, score="score", y="y")


@query("m18_threshold_sweep", rounded(_SWEEP_SQL + "SELECT * FROM f", *_SWEEP_D))
def m18_threshold_sweep(spark, sf):
    return finish(_sweep(spark, sf))


@query("w04_best_threshold", rounded(
    _SWEEP_SQL + "SELECT * FROM f ORDER BY score DESC, position ASC LIMIT 1", *_SWEEP_D))
def w04_best_threshold(spark, sf):
    return finish(E.best_candidate(_sweep(spark, sf), "score"))


_F06_D = ("threshold", "normal_recall", "attack_recall", "false_alerts_per_day",
          "true_alerts_per_day", "missed_attacks_per_day", "total_alerts_per_day",
          "operational_precision")


@query("f06_alert_workload", rounded(_SWEEP_SQL + """, r AS (SELECT position, threshold,
  CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS normal_recall, recall AS attack_recall FROM f)
SELECT *, 995000.0 * (1 - normal_recall) AS false_alerts_per_day, 5000.0 * attack_recall AS true_alerts_per_day,
  5000.0 * (1 - attack_recall) AS missed_attacks_per_day,
  995000.0 * (1 - normal_recall) + 5000.0 * attack_recall AS total_alerts_per_day,
  CASE WHEN 995000.0 * (1 - normal_recall) + 5000.0 * attack_recall = 0 THEN 0.0
       ELSE 5000.0 * attack_recall / (995000.0 * (1 - normal_recall) + 5000.0 * attack_recall) END AS operational_precision
FROM r""", *_F06_D))
def f06_alert_workload(spark, sf):
    sw = _sweep(spark, sf)
    rates = sw.select("position", "threshold",
                      E._div(F.col("tn"), F.col("tn") + F.col("fp")).alias("normal_recall"),
                      F.col("recall").alias("attack_recall"))
    return finish(E.alert_workload(rates))


@query("a33_bootstrap_ci")
def a33_bootstrap_ci(spark, sf):
    return finish(E.bootstrap_ci(scored(spark, sf), 300, 42, "y", "yhat"))


@query("p11_threshold_predict", with_(SCORED) + """
SELECT split, CAST((score >= 0.35::DOUBLE)::INT AS INT) AS yhat, CAST(count(*) AS BIGINT) AS n
FROM scored GROUP BY ALL""")
def p11_threshold_predict(spark, sf):
    s = scored(spark, sf)
    return s.groupBy("split", threshold_predict(F.col("score"), 0.35).alias("yhat")).agg(
        F.count(F.lit(1)).alias("n"))
