"""Registered preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import prep as P
from flowlab.operators import relate as R
from flowlab.operators import sample as S
from flowlab.plans import finish, query, rounded
from flowlab.plans.sample_q import D03_SQL
from flowlab.plans.sql import EVENT_FEATURES, FLOWS, NUMERIC, SCORED, with_
from flowlab.sources.tables import (EVENT_NUMERIC, FLOW_CATEGORICAL, FLOW_NUMERIC, event_features,
                                    flows, scored, table)

CAT = FLOW_CATEGORICAL


def _fitted(spark, sf):
    f = flows(spark, sf)
    return f, P.fit(f.where(F.col("split") == "train"), CAT, FLOW_NUMERIC)


_VOCAB = with_(FLOWS, "v AS (" + "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS category FROM flows WHERE split = 'train' AND {c} IS NOT NULL"
    for c in CAT) + ")")


@query("t01_onehot_vocab", _VOCAB + """
SELECT feature, category, CAST(row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS INT) AS position FROM v""")
def t01_onehot_vocab(spark, sf):
    _, fp = _fitted(spark, sf)
    rows = [(c, v, i) for c in CAT for i, v in enumerate(fp.vocab[c])]
    return spark.createDataFrame(rows, "feature string, category string, position int")


@query("t01_unseen_all_zero", _VOCAB + """
SELECT f.feature, CAST(count(*) AS BIGINT) AS all_zero_rows FROM (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM flows WHERE split = 'test'" for c in CAT) + """) f
WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.feature = f.feature AND v.category = f.value) GROUP BY f.feature""")
def t01_unseen_all_zero(spark, sf):
    f, fp = _fitted(spark, sf)
    wide = fp.apply(f.where(F.col("split") == "test"))
    parts = []
    for c in CAT:
        block = [F.col(f"`{c}_{v}`") for v in fp.vocab[c]]
        zero = (sum(block[1:], block[0]) == 0) if block else F.lit(True)
        parts.append(F.sum(zero.cast("long")).alias(c))
    wideagg = wide.agg(*parts)
    long = wideagg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                       F.col(c).alias("all_zero_rows")) for c in CAT]))
                          .alias("s")).select("s.*")
    return long.where(F.col("all_zero_rows") > 0)


_STATS = with_(FLOWS) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std FROM flows WHERE split = 'train'"
    for c in NUMERIC)


@query("t02_zscore_stats", rounded(_STATS, "mean", "std"))
def t02_zscore_stats(spark, sf):
    return finish(P.zscore_stats(flows(spark, sf).where(F.col("split") == "train"), FLOW_NUMERIC))


@query("t03_test_totals", rounded(_VOCAB + ", st AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg({c}) AS m, stddev_pop({c}) AS s FROM flows WHERE split = 'train'" for c in NUMERIC)
    + ")" + """
SELECT v.feature || '_' || v.category AS feature, CAST(count(t.value) AS DOUBLE) AS total
FROM v LEFT JOIN (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM flows WHERE split = 'test'" for c in CAT) + """) t
  ON t.feature = v.feature AND t.value = v.category GROUP BY v.feature, v.category
UNION ALL
""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, sum(({c} - (SELECT m FROM st WHERE feature = '{c}'))
  / (SELECT CASE WHEN s = 0 THEN 1.0 ELSE s END FROM st WHERE feature = '{c}')) AS total FROM flows WHERE split = 'test'"""
    for c in NUMERIC), "total"))
def t03_test_totals(spark, sf):
    f, fp = _fitted(spark, sf)
    wide = fp.apply(f.where(F.col("split") == "test"))
    return finish(P.column_totals(wide, fp.feature_names()))


@query("t08_feature_names", _VOCAB + """
SELECT CAST(row_number() OVER (ORDER BY k, category) - 1 AS INT) AS position, name FROM (
  SELECT CASE feature WHEN 'protocol_type' THEN 0 WHEN 'service' THEN 1 ELSE 2 END AS k, category,
    feature || '_' || category AS name FROM v
  UNION ALL SELECT 3 + i AS k, '' AS category, n AS name
  FROM (SELECT unnest(""" + str(NUMERIC) + """) AS n, unnest(range(0, """ + str(len(NUMERIC)) + """)) AS i))""")
def t08_feature_names(spark, sf):
    _, fp = _fitted(spark, sf)
    return spark.createDataFrame(list(enumerate(fp.feature_names())), "position int, name string")


# ±Inf injected into every 101st value, train-median imputation, then scaling
def _ef_inf(spark, sf):
    ef = event_features(spark, sf)
    return ef.withColumn("value", F.when(F.col("row_key") % 101 == 0, F.lit(float("inf")))
                         .otherwise(F.col("value")))


_EF_INF = with_(EVENT_FEATURES, """e AS (SELECT * REPLACE (CASE WHEN row_key % 101 = 0 THEN 'Infinity'::DOUBLE
  ELSE value END AS value) FROM ef)""", """e2 AS (SELECT * REPLACE (CASE WHEN isinf(value) THEN NULL ELSE value END AS value) FROM e)""",
                  "md AS (" + "\nUNION ALL\n".join(
                      f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median FROM e2 WHERE split = 'train'"
                      for c in EVENT_NUMERIC) + ")")


@query("t05_median_impute", rounded(_EF_INF + "SELECT feature, median FROM md", "median"))
def t05_median_impute(spark, sf):
    fp = P.fit(_ef_inf(spark, sf).where(F.col("split") == "train"), [], EVENT_NUMERIC, impute_median=True)
    return finish(spark.createDataFrame([(c, fp.median[c]) for c in EVENT_NUMERIC],
                                        "feature string, median double"))


@query("t06_scale_only_totals", rounded(_EF_INF + ", imp AS (SELECT split, " + ", ".join(
    f"coalesce({c}, (SELECT median FROM md WHERE feature = '{c}')) AS {c}" for c in EVENT_NUMERIC) + " FROM e2), st AS ("
    + "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, avg({c}) AS m, stddev_pop({c}) AS s FROM imp WHERE split = 'train'"
                           for c in EVENT_NUMERIC) + ")\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, sum(({c} - (SELECT m FROM st WHERE feature = '{c}'))
  / (SELECT CASE WHEN s = 0 THEN 1.0 ELSE s END FROM st WHERE feature = '{c}')) AS total FROM imp WHERE split = 'test'"""
    for c in EVENT_NUMERIC), "total"))
def t06_scale_only_totals(spark, sf):
    e = _ef_inf(spark, sf)
    fp = P.fit(e.where(F.col("split") == "train"), [], EVENT_NUMERIC, impute_median=True)
    return finish(P.column_totals(fp.apply(e.where(F.col("split") == "test")), fp.feature_names()))


@query("t07_dev_fit_stats", rounded(
    "WITH d AS (" + D03_SQL + "), x AS (SELECT d.role, ev.value, CAST(ev.user_id AS DOUBLE) AS user_id "
    "FROM d JOIN events ev ON ev.event_id = d.row_key)\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std FROM x WHERE role = 'train'"
        for c in ["value", "user_id"]), "mean", "std"))
def t07_dev_fit_stats(spark, sf):
    s = scored(spark, sf)
    split = S.stratified_split(s, "attack_family", "row_key", 0.2)
    ev = event_features(spark, sf).select("row_key", "value", "user_id")
    dev = split.where(F.col("role") == "train").select("row_key").join(ev, "row_key")
    fp = P.fit(dev, [], ["value", "user_id"])
    return finish(spark.createDataFrame([(c, fp.mean[c], fp.std[c]) for c in ["value", "user_id"]],
                                        "feature string, mean double, std double"))


@query("t09_max_normalise", rounded(with_(FLOWS, "m AS (" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, covar_pop({c}, binary_label::DOUBLE) AS cv, stddev_pop({c}) AS sx,
  stddev_pop(binary_label::DOUBLE) AS sy FROM flows""" for c in NUMERIC) + ")",
    """r AS (SELECT feature, abs(CASE WHEN sx = 0 OR sy = 0 OR sx IS NULL THEN 0.0 ELSE cv / (sx * sy) END) AS a FROM m)""") + """
SELECT feature, a AS abs_target_corr, CASE WHEN max(a) OVER () <= 0 THEN 0.0 ELSE a / max(a) OVER () END AS abs_target_corr_norm FROM r""",
    "abs_target_corr", "abs_target_corr_norm"))
def t09_max_normalise(spark, sf):
    tc = R.target_correlation(flows(spark, sf), FLOW_NUMERIC).select("feature", "abs_target_corr")
    return finish(P.max_normalise(tc, "abs_target_corr"))


@query("t10_minmax_scores", rounded(with_(SCORED) + """
SELECT row_key, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-12) AS score01 FROM scored""",
    "score01"))
def t10_minmax_scores(spark, sf):
    return finish(P.minmax_scores(scored(spark, sf)).select("row_key", "score01"))


# Wide vocabularies: order, part and supplier keys of the lines are categories; orders divisible by 5 are test rows, so theirs are unseen.
KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]


@query("t03_sparse_totals", """WITH l AS (SELECT *, l_orderkey % 5 = 0 AS test FROM lineitem),
c AS (""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, test FROM l WHERE {c} IS NOT NULL" for c in KEYS) + """),
v AS (SELECT DISTINCT "column", value FROM c WHERE NOT test)
SELECT "column", count(DISTINCT v.value)::BIGINT AS categories, coalesce(sum(n_train), 0)::BIGINT AS train_ones, coalesce(sum(n_test), 0)::BIGINT AS test_ones
FROM v LEFT JOIN (SELECT "column", value, sum((NOT test)::INT) AS n_train, sum(test::INT) AS n_test FROM c GROUP BY ALL) t USING ("column", value) GROUP BY 1""")
def t03_sparse_totals(spark, sf):
    """Ones of every column's sparse block, on train and test rows."""
    rows = table(spark, sf, "lineitem").withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    prep = P.fit_sparse(rows.where("split = 'train'"), KEYS, ["l_quantity"])
    # by position, and not as a vector as long as the vocabulary: its cells are a row's ones and numbers
    cells = prep.transform(rows).select("split", F.unwrap_udt("features").alias("v")).select("split", F.explode(F.arrays_zip("v.indices", "v.values")).alias("x"))
    totals = cells.groupBy(F.col("x.indices").alias("position")).agg(*[F.sum(F.when(F.col("split") == s, F.col("x.values"))).alias(s) for s in ("train", "test")])
    return (prep.vocab.join(totals, "position", "left").groupBy("column")
            .agg(F.count("*").alias("categories"), F.sum("train").cast("long").alias("train_ones"), F.coalesce(F.sum("test"), F.lit(0)).cast("long").alias("test_ones")))
