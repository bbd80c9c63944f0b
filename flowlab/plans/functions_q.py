"""Registered scalar-function queries (F01-F10 except F06, W06, A31)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flowlab.functions import columns as C
from flowlab.operators import evaluate as E
from flowlab.plans import finish, query, rounded
from flowlab.plans.evaluate_q import scored5
from flowlab.plans.quality_q import AUDITED_SQL, audited
from flowlab.plans.sql import EVENT_FEATURES, SCORED, SCORED5, with_
from flowlab.sources.tables import embeddings, event_features, scored

_ACT = ["linear", "linear_derivative", "sigmoid", "sigmoid_derivative", "tanh", "tanh_derivative",
        "relu", "relu_derivative", "leaky_relu", "leaky_relu_derivative", "elu", "elu_derivative", "gelu"]
_K = math.sqrt(2 / math.pi)


@query("f01_activations", rounded(f"""
WITH a AS (SELECT event_id AS row_key, (value - 50.0) / 25.0 AS x FROM events)
SELECT row_key, x AS linear, 1.0::DOUBLE AS linear_derivative, 1 / (1 + exp(-x)) AS sigmoid,
  (1 / (1 + exp(-x))) * (1 - 1 / (1 + exp(-x))) AS sigmoid_derivative, tanh(x) AS tanh,
  1 - tanh(x) * tanh(x) AS tanh_derivative, greatest(0.0, x) AS relu, (x > 0)::INT::DOUBLE AS relu_derivative,
  CASE WHEN x > 0 THEN x ELSE 0.01 * x END AS leaky_relu, CASE WHEN x > 0 THEN 1.0 ELSE 0.01 END AS leaky_relu_derivative,
  CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END AS elu, CASE WHEN x > 0 THEN 1.0 ELSE exp(x) END AS elu_derivative,
  0.5 * x * (1 + tanh({_K!r} * (x + 0.044715 * x * x * x))) AS gelu
FROM a""", *_ACT))
def f01_activations(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    x = (F.col("value") - F.lit(50.0)) / F.lit(25.0)
    return finish(ev.select(F.col("event_id").alias("row_key"), *C.activations(x)))


@query("f02_softmax", rounded("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, list_transform(v, lambda t: exp(t - list_max(v))) AS ex FROM e)
SELECT vec_id, list_max(ex) / list_sum(ex) AS p_max, ex[1] / list_sum(ex) AS p_first FROM s""", "p_max", "p_first"))
def f02_softmax(spark, sf):
    e = embeddings(spark, sf).select("vec_id", C.softmax(F.col("embedding")).alias("p"))
    return finish(e.select("vec_id", F.array_max("p").alias("p_max"), F.element_at("p", 1).alias("p_first")))


@query("f03_bce_step", rounded(with_(EVENT_FEATURES) + """,
z AS (SELECT binary_label::DOUBLE AS y, value / 100.0 AS x0, k / 100.0 AS x1,
  1 / (1 + exp(-(-0.1 + 0.3 * (value / 100.0) + (-0.2) * (k / 100.0)))) AS p FROM ef),
g AS (SELECT avg(-(y * ln(p + 1e-12) + (1 - y) * ln(1 - p + 1e-12))) AS loss, avg((p - y) * x0) AS grad_w0,
  avg((p - y) * x1) AS grad_w1, avg(p - y) AS grad_b FROM z)
SELECT loss, grad_w0, grad_w1, grad_b, 0.3 - 0.1 * grad_w0 AS w0_next, -0.2 - 0.1 * grad_w1 AS w1_next,
  -0.1 - 0.1 * grad_b AS b_next FROM g""", "loss", "grad_w0", "grad_w1", "grad_b", "w0_next", "w1_next", "b_next"))
def f03_bce_step(spark, sf):
    ef = event_features(spark, sf).select((F.col("value") / 100.0).alias("x0"), (F.col("k") / 100.0).alias("x1"),
                                          "binary_label")
    return finish(C.bce_step(ef, ["x0", "x1"], "binary_label", [0.3, -0.2], -0.1, 0.1))


_W_SQL = """w AS (SELECT sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n0, sum(y) AS n1, count(*) AS n FROM scored),
ww AS (SELECT n / (2.0 * greatest(n0, 1)) AS w0, n / (2.0 * greatest(n1, 1)) AS w1 FROM w)"""


@query("f05_losses", rounded(with_(SCORED, _W_SQL) + """,
z AS (SELECT y, least(greatest(score, 1e-12), 1 - 1e-12) AS p, CASE WHEN y = 1 THEN (SELECT w1 FROM ww) ELSE (SELECT w0 FROM ww) END AS wy FROM scored),
c AS (SELECT *, -ln(CASE WHEN y = 1 THEN p ELSE 1 - p END) AS ce, (-ln(p) - ln(1 - p)) / 2 AS mk FROM z)
SELECT avg(ce) AS ce, sum(wy * ce) / sum(wy) AS weighted_ce, avg(0.9 * ce + 0.1 * mk) AS smoothed_ce,
  avg(pow(1 - exp(-wy * ce), 2) * wy * ce) AS focal FROM c""", "ce", "weighted_ce", "smoothed_ce", "focal"))
def f05_losses(spark, sf):
    s = scored(spark, sf)
    w = {r["y"]: r["weight"] for r in C.balanced_weights(s, "y", 2).collect()}  # K rows
    return finish(C.binary_losses(s, "score", "y", w, 0.1, 2.0))


@query("a31_class_weights", rounded(with_(SCORED5) + """,
c AS (SELECT y5, count(*) AS n_c FROM scored5 GROUP BY y5)
SELECT CAST(r.i AS INT) AS y5, CAST(coalesce(c.n_c, 0) AS BIGINT) AS n_c,
  (SELECT count(*) FROM scored5) / (5.0 * greatest(coalesce(c.n_c, 0), 1)) AS weight
FROM range(5) r(i) LEFT JOIN c ON c.y5 = r.i""", "weight"))
def a31_class_weights(spark, sf):
    return finish(C.balanced_weights(scored5(spark, sf), "y5", 5))


@query("f07_safe_float", with_(AUDITED_SQL) + """
SELECT count(*) AS rows, count(CASE WHEN isnan(f_inf) OR isinf(f_inf) THEN NULL ELSE f_inf END) AS finite_values FROM audited""")
def f07_safe_float(spark, sf):
    a = audited(spark, sf)
    return a.agg(F.count(F.lit(1)).alias("rows"), F.count(C.safe_float(F.col("f_inf"))).alias("finite_values"))


@query("f08_stable_id", """
SELECT DISTINCT event_type, user_id, substr(sha256(concat_ws('::', 'events', event_type, CAST(user_id AS VARCHAR))), 1, 16) AS experiment_id
FROM events""")
def f08_stable_id(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "user_id").distinct()
    return ev.select("event_type", "user_id",
                     C.stable_id(F.lit("events"), F.col("event_type"), F.col("user_id")).alias("experiment_id"))


@query("f09_half_even", rounded(with_(SCORED) + """
SELECT user_id, label, count(*) AS n, round_even(1234 * count(*) / sum(count(*)) OVER (), 0) AS quota, round_even(count(*) / 2.0, 0)::DOUBLE AS half
FROM scored GROUP BY user_id, label""", "quota", "half"))
def f09_half_even(spark, sf):
    c = scored(spark, sf).groupBy("user_id", "label").agg(F.count(F.lit(1)).alias("n"))  # many odd counts: halves end in .5
    tot = c.agg(F.sum("n").alias("_t"))
    from flowlab.operators.ordered import attach_totals
    j = attach_totals(c, tot)
    return finish(j.select("user_id", "label", "n", C.half_even(F.lit(1234) * F.col("n") / F.col("_t")).alias("quota"),
                           C.half_even(F.col("n") / 2).alias("half")))


@query("f10_strings_safe_division", rounded(with_(SCORED) + """
SELECT user_id, concat_ws(' | ', 'user', CAST(user_id AS VARCHAR)) AS tag,
  array_to_string(list_sort(list_distinct(list(label))), ', ') AS labels,
  CASE WHEN sum((label = 'view')::INT) = 0 THEN NULL ELSE sum((label = 'purchase')::INT)::DOUBLE / sum((label = 'view')::INT) END AS purchase_per_view,
  greatest(count(*), 10) AS rows_at_least_10
FROM scored GROUP BY user_id""", "purchase_per_view"))
def f10_strings_safe_division(spark, sf):
    s = scored(spark, sf)
    g = s.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"),
        F.sum((F.col("label") == "purchase").cast("int")).alias("_p"),
        F.sum((F.col("label") == "view").cast("int")).alias("_v"), F.count(F.lit(1)).alias("_n"))
    return finish(g.select("user_id", F.concat_ws(" | ", F.lit("user"), F.col("user_id").cast("string")).alias("tag"),
                           "labels", C.safe_divide(F.col("_p"), F.col("_v")).alias("purchase_per_view"),
                           F.greatest(F.col("_n"), F.lit(10)).alias("rows_at_least_10")))


@query("w06_central_difference", rounded("""
WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(count(*) AS DOUBLE) AS events FROM events GROUP BY ALL),
d AS (SELECT hour, events, lag(events) OVER (ORDER BY hour) AS p, lead(events) OVER (ORDER BY hour) AS n FROM h)
SELECT hour, events, CASE WHEN p IS NULL AND n IS NULL THEN NULL WHEN p IS NULL THEN n - events
  WHEN n IS NULL THEN events - p ELSE (n - p) / 2.0 END AS events_derivative FROM d""", "events", "events_derivative"))
def w06_central_difference(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    # hourly series: bounded by the number of hours, so one ordered window is fine
    h = ev.groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("hour")) \
        .agg(F.count(F.lit(1)).cast("double").alias("events"))
    return finish(C.central_difference(h, "events", "hour", 1.0))


@query("f04_fbeta_f1", rounded(with_(SCORED, """v AS (SELECT y, score FROM scored WHERE split = 'test')""",
                                     """t AS (SELECT CAST(i - 5 AS INT) AS position, i / 100.0::DOUBLE AS threshold FROM range(5, 96) r(i))""",
                                     """c AS (SELECT t.position, t.threshold,
  sum(CASE WHEN v.score >= t.threshold AND v.y = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN v.score >= t.threshold AND v.y = 0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN v.score < t.threshold AND v.y = 1 THEN 1 ELSE 0 END) AS fn FROM t, v GROUP BY ALL)""",
                                     """s AS (SELECT position, threshold, tp / greatest(tp + fp, 1) AS precision,
  tp / greatest(tp + fn, 1) AS recall FROM c)""") + """
SELECT position, threshold, 2 * precision * recall / greatest(precision + recall, 1e-12) AS score FROM s""",
                               "threshold", "score"))
def f04_fbeta_f1(spark, sf):
    s = scored(spark, sf).where(F.col("split") == "test")
    return finish(E.threshold_sweep(s, beta=1.0, score="score", y="y").select("position", "threshold", "score"))
