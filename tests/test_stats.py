"""Quality, relation and outlier operators against numpy and worked-out values."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from flowlab.functions import columns as C
from flowlab.operators import audit as AU
from flowlab.operators import outlier as O
from flowlab.operators import prep as P
from flowlab.operators import quality as Q
from flowlab.operators import relate as R


def test_target_correlation_equals_numpy(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 400)
    x = np.column_stack([y + rng.normal(size=400), rng.normal(size=400), -2.0 * y, np.full(400, 3.5)])
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "near double, none double, minus double, flat double, y int")
    got = {r.feature: r.target_corr for r in R.target_correlation(df, ["near", "none", "minus", "flat"], "y").collect()}
    for i, c in enumerate(["near", "none", "minus"]):
        assert got[c] == pytest.approx(np.corrcoef(x[:, i], y)[0, 1])
    assert got["flat"] == 0.0


def test_correlation_pairs_equal_numpy(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 3))
    x = np.column_stack([base, base[:, 0] * -3 + 1, base[:, 1] + 0.4 * rng.normal(size=300)])
    names = list("pqrst")
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names))
    c = np.corrcoef(x.T)
    want = {(names[i], names[j]): c[i, j] for i in range(5) for j in range(i + 1, 5) if abs(c[i, j]) >= 0.9}
    got = {(p.feature_a, p.feature_b): p.corr for p in R.correlation_pairs(df, names, 0.9).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_iqr_rates_equal_numpy(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=500), [9.0, -8.0, 30.0]])
    df = spark.createDataFrame([(float(v), 7.0) for v in x], "x double, flat double")
    q1, q3 = np.quantile(x, [0.25, 0.75])
    rate = ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).mean()
    got = {r.feature: r.outlier_rate_iqr for r in O.outlier_rates(df, ["x", "flat"]).collect()}
    assert got == {"x": pytest.approx(rate), "flat": 0.0}


def test_row_scores(spark):
    train = spark.createDataFrame([(2.0, float(v)) for v in (1, 2, 3, 4, 5)], "flat double, x double")
    ref = O.iqr_reference(train, ["flat", "x"])  # x: quartiles 2 and 4, fences -1 and 7
    test = spark.createDataFrame([("in", 2.0, 7.0), ("one", 2.0, 11.0), ("two", 5.0, -3.0), ("null", None, None)], "k string, flat double, x double")
    rows = {r.k: r for r in O.score_rows(test, ref, ["flat", "x"]).collect()}
    assert {k: r.outlier_feature_count for k, r in rows.items()} == {"in": 0, "one": 1, "two": 2, "null": 0}
    assert rows["one"].max_abs_robust_z == pytest.approx(4.0) and rows["one"].top_outlier_features == "x"
    assert rows["two"].top_outlier_features == "x, flat" and rows["two"].outlier_feature_fraction == 1.0  # equal z: the later feature first


def test_feature_frequency_by_split(spark):
    long = spark.createDataFrame([(s, k, f, float(z)) for s, k, f, z in [("a", 1, "u", 1), ("a", 2, "u", 4), ("a", 2, "v", 6), ("b", 1, "u", 9)]],
                                 "split string, k int, feature string, abs_robust_z double")
    got = {(r.split, r.feature): (r.outlier_rows, r.mean_abs_robust_z) for r in O.feature_frequency(long).collect()}
    assert got == {("a", "u"): (2, 2.5), ("a", "v"): (1, 6.0), ("b", "u"): (1, 9.0)}


def test_column_quality_and_duplicates(spark):
    rows = [(float(i % 3), 0.0, 1.0 if i == 0 else 0.0) for i in range(2000)] + [(0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, const double, near double")
    cq = {r.feature: r for r in Q.column_quality(df, ["a", "const", "near"]).collect()}
    assert cq["const"].is_constant and not cq["const"].is_near_constant
    assert cq["near"].is_near_constant and cq["near"].dominant_share == pytest.approx(2000 / 2001)
    assert not cq["a"].is_near_constant and cq["a"].dominant_share is None
    assert Q.duplicate_rows(df).first().duplicate_rows == 2001 - 3 - 1


def test_zscore_uses_train_statistics(spark):
    train = spark.createDataFrame([(1.0, "tcp"), (3.0, "udp")], "x double, proto string")
    test = spark.createDataFrame([(5.0, "icmp")], "x double, proto string")
    fp = P.fit(train, ["proto"], ["x"])
    assert fp.mean["x"] == 2.0 and fp.std["x"] == 1.0  # population std
    row = fp.apply(test).first().asDict()
    assert row["x"] == 3.0
    assert row["proto_tcp"] == 0.0 and row["proto_udp"] == 0.0  # unseen -> all-zero block
    assert fp.feature_names() == ["proto_tcp", "proto_udp", "x"]


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(2,)] * 2, "y int")
    w = {r.y: r.weight for r in C.balanced_weights(df, "y", 3).collect()}
    assert w == {0: pytest.approx(8 / 18), 1: pytest.approx(8 / 3), 2: pytest.approx(8 / 6)}  # class 1 is absent: finite


def test_activations_and_softmax(spark):
    df = spark.createDataFrame([(0.0, [1.0, 2.0, 3.0])], "x double, v array<double>")
    r = df.select(*C.activations(F.col("x")), C.softmax(F.col("v")).alias("p")).first()
    assert r.sigmoid == 0.5 and r.relu == 0.0 and r.gelu == 0.0
    assert sum(r.p) == pytest.approx(1.0) and r.p[2] > r.p[1] > r.p[0]


def test_nan_and_strings_in_the_audit(spark):
    rows = [(float("nan"), "a")] * 2 + [(1.0, "a")] * 3 + [(None, None)]
    cq = {r.feature: r for r in Q.column_quality(spark.createDataFrame(rows, "x double, s string"), ["x", "s"]).collect()}
    assert cq["x"].missing == 3 and cq["x"].dominant_share == 1.0 and not cq["x"].is_constant
    assert cq["s"].missing == 1 and cq["s"].dominant_share == 1.0


def test_sparse_one_hot(spark):
    train = spark.range(3000).selectExpr("concat('v', lpad(id % 1500, 5, '0')) AS big", "id % 3 AS small")
    vocab = P.vocabulary(train, ["small", "big"])
    rows = sorted((r.position, r.column, r.value) for r in vocab.collect())
    assert [p for p, *_ in rows] == list(range(1503)) and rows[:3] == [(0, "small", "0"), (1, "small", "1"), (2, "small", "2")]
    assert [v for _, c, v in rows if c == "big"] == [f"v{i:05}" for i in range(1500)]
    test = spark.createDataFrame([(1, "v00007", 2), (2, "new", None)], "k int, big string, small long")
    assert {r.k: r.positions for r in P.one_hot_sparse(test, "k", ["small", "big"], vocab).collect()} == {1: [2, 10], 2: []}


def test_sparse_prep_with_200_000_categories(spark):
    """A logistic fit on sparse blocks; unseen values and nulls have no one; numeric columns follow."""
    rows = spark.range(220_000).select("id", F.concat(F.lit("v"), "id").alias("big"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("small"),
                                       (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    train, test = rows.where("id < 200000"), rows.where("id >= 200000").withColumn("small", F.when(F.col("id") % 3 > 0, F.col("small")))
    prep = P.fit_sparse(train, ["big", "small"], ["x"])
    assert prep.sizes == {"big": 200_000, "small": 2}
    ends = prep.vocab.groupBy("column").agg(F.min("position"), F.max("position"))
    assert {tuple(r) for r in ends.collect()} == {("big", 0, 199_999), ("small", 200_000, 200_001)}
    made = prep.transform(test)
    assert made.columns == [*test.columns, "features"]
    for r in made.where("id < 200012").collect():
        ones = [200_000 + int(r.small == "b")] if r.small else []
        assert r.features.size == 200_003 and [i for i in r.features.indices if i < 200_002] == ones
        assert r.features[200_002] == pytest.approx((r.x - 3) / 2, abs=1e-3)
    one = prep.transform(train.where("id = 17")).first().features
    place = sorted(f"v{i}" for i in range(200_000)).index("v17")
    assert list(one.indices[:2]) == [place, 200_001]
    model = LogisticRegression(maxIter=5, regParam=0.01).fit(prep.transform(train))
    hit = model.transform(made.where("small is not null")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert hit == 1.0


def test_sparse_vectors_have_no_attribute_a_category(spark):
    """Names of categories in a column's metadata are objects on the driver, one a category."""
    rows = spark.range(500).select(F.concat(F.lit("v"), "id").alias("big"), F.lit(None).cast("string").alias("none"), (F.col("id") % 5).alias("x"))
    made = P.fit_sparse(rows, ["none", "big"], ["x"]).transform(rows)
    assert not made.schema["features"].metadata
    r = made.where("x = 2 and big = 'v2'").first().features
    assert r.size == 501 and list(r.indices) == [sorted(f"v{i}" for i in range(500)).index("v2")] and r[500] == 0


def test_encoded_stats_of_one_hot_columns_from_counts(spark, monkeypatch):
    """As the general operators give them on the dense columns, which are not made."""
    rows = spark.range(400).select(F.when(F.col("id") % 9 > 0, F.concat(F.lit("c"), F.least(F.col("id") % 10, F.lit(4)))).alias("cat"), F.lit("one").alias("flat"),
                                   F.sin("id").alias("x"), F.when(F.col("id") % 11 > 0, (F.col("id") % 10 > 5).cast("int")).alias("binary_label"))
    fp = P.fit(rows, ["cat", "flat"], ["x"])
    names = fp.feature_names()
    wide = fp.apply(rows, keep=["binary_label"])
    want = {r.feature: r.target_corr for r in R.target_correlation(wide, names).collect()}
    rate = {r.feature: r.outlier_rate_iqr for r in O.outlier_rates(wide, names).collect()}
    seen = []
    monkeypatch.setattr(AU.O, "outlier_rates", lambda df, features, good=O.outlier_rates: seen.append(features) or good(df, features))
    got = {r.encoded_feature: r for r in AU.encoded_stats(rows, fp).collect()}
    assert seen == [["x"]] and sorted(got) == sorted(names)
    for f, r in got.items():
        assert r.target_corr == pytest.approx(want[f], abs=1e-12) and r.abs_target_corr == abs(r.target_corr)
        assert r.outlier_rate_iqr == pytest.approx(rate[f], abs=1e-12)
        assert r.attribute == f.split("_")[0]
