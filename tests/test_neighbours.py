import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import neighbours as N
from flowlab.operators.neighbours import knn


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "id long, embedding array<double>")


def brute(qids, q, ids, x, k, exclude=False):
    out = {}
    for i, v in zip(qids, q, strict=True):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        rows = sorted((float(a), int(b)) for a, b in zip(d, ids, strict=True) if not (exclude and b == i))
        out[int(i)] = [b for _, b in rows[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.neighbor_id)
    return out


def test_equal_distances_give_the_smallest_ids(spark):
    ref = frame(spark, range(1000, 0, -1), np.ones((1000, 3)))
    assert got(knn(frame(spark, [7], np.zeros((1, 3))), ref, 5, block_rows=100)) == {7: [1, 2, 3, 4, 5]}


@pytest.mark.parametrize("exclude", [False, True])
def test_equals_brute_force(spark, exclude):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(1500, 4)), np.repeat(rng.normal(size=(10, 4)), 60, axis=0)])
    ids = rng.permutation(len(x))
    q = x[:200]
    for size in (0, 1 << 25):
        rows = knn(frame(spark, ids[:200], q), frame(spark, ids, x).repartition(7), 7, exclude_self=exclude, block_rows=50, broadcast_bytes=size)
        assert got(rows) == brute(ids[:200], q, ids, x, 7, exclude)


def test_rows_at_one_distance_and_hot_blocks(spark, monkeypatch):
    """One-hot vectors: every row of a cell is in one ring, which is cut into parts; visits are split over copies."""
    monkeypatch.setattr(N, "VISITS", 20)
    monkeypatch.setattr(N, "BATCH", 8)
    x = np.vstack([np.eye(120), np.zeros((40, 120))])
    ids = np.arange(len(x))
    rows = knn(frame(spark, ids, x), frame(spark, ids, x), 3, block_rows=25, broadcast_bytes=0, exclude_self=True)
    assert got(rows) == brute(ids, x, ids, x, 3, True)


def test_recall_of_probes(spark):
    """Five of some forty blocks: at least 0.95 of the neighbours in clustered rows."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 8)) * 6)[rng.integers(0, 30, 2000)] + rng.normal(size=(2000, 8))
    ids = np.arange(2000)
    want = brute(ids[:300], x[:300], ids, x, 5)
    found = got(knn(frame(spark, ids[:300], x[:300]), frame(spark, ids, x), 5, block_rows=50, broadcast_bytes=0, probes=5))
    assert np.mean([len(set(found[i]) & set(want[i])) / 5 for i in want]) >= 0.95


def test_fewer_rows_than_k_and_empty_reference(spark):
    ref = frame(spark, [4, 2], np.array([[0.0], [1.0]]))
    assert got(knn(ref, ref, 5, exclude_self=True)) == {4: [2], 2: [4]}
    assert knn(ref, ref.where("id < 0"), 3).count() == 0


def test_a_query_travels_once_to_a_group_of_blocks(spark, monkeypatch):
    """Bounds rule out little in 16 random dimensions: a query still goes to its home and once to each group, as floats."""
    stored = []
    monkeypatch.setattr(N, "store", lambda df, store=N.store: stored.append(store(df)) or stored[-1])
    x = np.random.default_rng(5).normal(size=(600, 16)).astype(np.float32)
    ids = np.arange(600)
    e = frame(spark, ids, x).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert got(knn(e, e, 4, block_rows=25, broadcast_bytes=0, exclude_self=True)) == brute(ids, x.astype(np.float64), ids, x.astype(np.float64), 4, True)
    trips = [t for t in stored if {"own", "x"} <= set(t.columns)]
    assert [t.agg(F.sum(F.size("own"))).first()[0] for t in trips] == [600, 600]
    assert {t.schema["x"].dataType.simpleString() for t in trips} == {"array<float>"}


def test_blocks_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(N, "VISITS", 100)
    x = np.random.default_rng(6).normal(size=(500, 6))
    ids = np.arange(500)
    e = frame(spark, ids, x)
    assert got(knn(e, e, 4, block_rows=20, broadcast_bytes=0, exclude_self=True)) == brute(ids, x, ids, x, 4, True)
