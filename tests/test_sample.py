"""Sampling and splitting: sizes, stratification, determinism, partition invariance."""

import pytest
from pyspark.sql import functions as F

from flowlab.operators import sample as S


def _df(spark, n0, n1, parts=None):
    df = spark.createDataFrame([(i, 0) for i in range(n0)] + [(n0 + i, 1) for i in range(n1)], "id long, y int")
    return df.repartition(parts) if parts else df


def test_stratified_cap_keeps_minority(spark):
    out = S.stratified_cap(_df(spark, 90, 10), "y", "id", 20)
    c = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert c == {0: 18, 1: 2}


def test_label_budget(spark):
    out = S.label_budget(_df(spark, 100, 50), "y", "id", 0.10)
    c = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert c == {0: 10, 1: 5}
    with pytest.raises(ValueError):
        S.label_budget(_df(spark, 10, 10), "y", "id", 0.0)


def test_split_disjoint_exhaustive(spark):
    out = S.stratified_split(_df(spark, 50, 50), "y", "id", 0.2)
    c = {(r.y, r.role): r["count"] for r in out.groupBy("y", "role").count().collect()}
    assert c == {(0, "validation"): 10, (0, "train"): 40, (1, "validation"): 10, (1, "train"): 40}
    assert out.select("id").distinct().count() == 100


def test_partition_invariance(spark):
    a = {r.id for r in S.stratified_cap(_df(spark, 300, 40, 1), "y", "id", 50).collect()}
    b = {r.id for r in S.stratified_cap(_df(spark, 300, 40, 7), "y", "id", 50).collect()}
    assert a == b


def test_ranked_within_buckets_exact(spark):
    df = _df(spark, 1000, 5)
    one = {r.id: r.rank_in_class for r in S.ranked_within(df, "y", "id", buckets=1).collect()}
    many = {r.id: r.rank_in_class for r in S.ranked_within(df, "y", "id", buckets=64).collect()}
    assert one == many


def test_chunks(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    c = sorted((r.chunk_id, r["count"]) for r in S.chunk_ids(df, "k", 10).groupBy("chunk_id").count().collect())
    assert c == [(0, 10), (1, 10), (2, 5)]


def test_folds_balanced(spark):
    f = S.stratified_folds(_df(spark, 30, 9), "y", "id", 3)
    c = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert all(v == 10 for (y, _), v in c.items() if y == 0) and all(v == 3 for (y, _), v in c.items() if y == 1)


def _split_by_ranks(df, fraction):
    """The split as all rows' ranks in their class give it."""
    quotas = {r.y: int(round(r["count"] * fraction)) for r in df.groupBy("y").count().collect()}
    return sorted((r.y, r.id, "validation" if r.rank_in_class <= quotas[r.y] else "train") for r in S.ranked_within(df, "y", "id", buckets=8).collect())


@pytest.mark.parametrize("rows", [
    [(i, i % 3) for i in range(200)],
    [(i % 7, 0) for i in range(100)] + [(5, 1)] * 40 + [(1, 2)],  # a quota ends among rows of one key
    [(i if i % 4 else None, 0 if i % 5 else None) for i in range(90)] + [(None, 1)] * 9 + [(3, 1)]])
def test_split_equals_ranks_and_moves_no_rows(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "id long, y int").withColumn("wide", F.repeat(F.lit("x"), 9)).repartition(5).cache()
    expected = _split_by_ranks(df, 0.2)
    monkeypatch.setattr(S, "ROWS_PER_BUCKET", 10)
    out = S.stratified_split(df, "y", "id", 0.2)
    assert sorted((r.y, r.id, r.role) for r in out.collect()) == expected
    assert out.columns == ["y", "id", "wide", "role"]
    if rows[0] == (0, 0) and rows[1] == (1, 1):
        assert out._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0].count("Exchange hashpartitioning") == 0
        assert out.rdd.getNumPartitions() == 5


def test_split_of_nan_classes(spark):
    df = spark.createDataFrame([(i, float("nan") if i % 2 else 1.0) for i in range(40)], "id long, y double")
    assert {(str(r.y), r.role): r["count"] for r in S.stratified_split(df, "y", "id", 0.25).groupBy("y", "role").count().collect()} == {
        ("nan", "train"): 15, ("nan", "validation"): 5, ("1.0", "train"): 15, ("1.0", "validation"): 5}
