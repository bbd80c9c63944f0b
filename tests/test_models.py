"""Models learn separable blobs; k-NN/LOF agree with brute force; online models run."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlab.operators import anomaly as AN
from flowlab.operators import models as M
from flowlab.operators import neighbours as N


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        y = i % 2
        x = rng.normal(-1.0 if y == 0 else 1.0, 0.5, 8)
        rows.append((i, [float(v) for v in x], float(y), "test" if i % 5 == 0 else "train"))
    df = spark.createDataFrame(rows, "id long, x array<double>, label double, split string")
    df = df.withColumn("features", array_to_vector("x"))
    return M.Data(M.with_weights(df, fitted=df.where("split = 'train'") if "split" in df.columns else None), ["normal", "attack"], "id")


@pytest.mark.parametrize("make", [
    lambda tr: M.logistic(tr, 1.0, True), lambda tr: M.decision_tree(True, 5, 3),
    lambda tr: M.random_forest(20, 5, 3, True), lambda tr: M.mlp(8, 2, (16,))])
def test_models_learn_blobs(blobs, make):
    pred, _ = M.fit_predict(make(blobs.train), blobs.train, blobs.test)
    assert M.evaluate_row(pred, blobs.classes).first().accuracy > 0.75


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    nn = N.knn(df, df, 3, "id", "id", "v", exclude_self=True, block_rows=25)
    got = {(r.query_id, r.rank): r.neighbor_id for r in nn.collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for q in range(60):
        order = np.lexsort((np.arange(60), d[q]))[:3]
        assert [got[(q, k + 1)] for k in range(3)] == list(order)


def test_lof_flags_far_point(spark):
    rng = np.random.default_rng(2)
    ref = [(i, [float(v) for v in rng.normal(size=2)]) for i in range(50)]
    q = spark.createDataFrame(ref + [(999, [8.0, 8.0])], "id long, v array<double>")
    scores = {r.query_id: r.lof for r in N.lof_scores(spark.createDataFrame(ref, "id long, v array<double>"), q,
                                                       5, "id", "id", "v").collect()}
    assert scores[999] > 3 * np.median(list(scores.values()))


def test_anomaly_scores_rank_outlier(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(200)] + [(999, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>").withColumn("features", array_to_vector("x"))
    normal = df.where(F.col("id") < 200)
    for sc in (AN.kmeans_distance(normal, df, 4), AN.isolation_forest(normal, df, "id", 20, 64)):
        top = sc.orderBy(F.col("score").desc()).first()
        assert top.id == 999


def test_normal_quantile_threshold(spark):
    tr = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "score double")
    assert AN.normal_quantile_threshold(tr, 0.75) == pytest.approx(3.25)


def test_grid_search_reads_stored_folds(blobs, monkeypatch):
    """Folds and fits read the ranked rows without another shuffle, and see each train row in its fold."""
    seen = {}

    def fit(_, df):
        seen["plan"] = df._jdf.queryExecution().executedPlan().toString()
        seen["rows"] = sorted(map(tuple, df.select("id", "label", "fold", "weight").collect()))

    monkeypatch.setattr(M.CrossValidator, "fit", fit)
    M.grid_search(blobs, M.random_forest(3, 3, 1, True), {"maxDepth": [2, 3]})
    assert "Exchange" not in seen["plan"]
    assert seen["rows"] == sorted(map(tuple, M.stratified_folds(blobs.train, "label", "id", 3, 42).select("id", "label", "fold", "weight").collect()))
