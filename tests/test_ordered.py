"""Scale primitives: exact quantiles, covariance pass, global running totals."""

import numpy as np
import pytest

from flowlab.operators import ordered as OR
from flowlab.operators import relate as R


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.integers(0, 3, 500).astype(float)])
    df = spark.createDataFrame([(float(x), None if i % 9 == 0 else float(-x)) for i, x in enumerate(v)],
                               "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = OR.exact_quantiles(df, ["a", "b"], probs, limit=300)  # small limit forces narrowing
    b = np.array([-x for i, x in enumerate(v) if i % 9])
    assert np.allclose(got["a"], np.quantile(v, probs))
    assert np.allclose(got["b"], np.quantile(b, probs))


def test_exact_quantiles_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert OR.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_covariance_matrix(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3)) * [1.0, 10.0, 0.0] + [1e6, 0.0, 5.0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(5)
    n, cov = R.covariance_matrix(df, ["a", "b", "c"])
    assert n == 500
    assert np.allclose(cov, np.cov(x, rowvar=False, bias=True), rtol=1e-9, atol=1e-9)


def test_global_row_number_and_running_totals(spark):
    df = spark.createDataFrame([(float(i % 37) + i / 1000.0, i % 3) for i in range(400)], "s double, p int")
    rn = {r.s: r.rn for r in OR.global_row_number(df, ["s"], "rn", buckets=7).collect()}
    assert sorted(rn.values()) == list(range(1, 401))
    assert all(rn[a] < rn[b] for a, b in zip(sorted(rn), sorted(rn)[1:]))
    rt = OR.running_totals(df, "s", ["p"], descending=True, buckets=5).collect()
    order = sorted(rt, key=lambda r: -r.s)
    assert [r.cum_p for r in order] == list(np.cumsum([r.p for r in order]))


def test_quantile_jobs_do_not_grow_with_columns(spark):
    df = spark.range(20_000).selectExpr(*[f"pmod(xxhash64(id, {i}), 1000003) / 7.0 AS c{i}" for i in range(6)]).repartition(4)

    def jobs(cols, group):
        spark.sparkContext.setJobGroup(group, group)
        OR.exact_quantiles(df, cols, [0.25, 0.5, 0.75], limit=20, accuracy=50)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    one, six = jobs(["c0"], "one"), jobs([f"c{i}" for i in range(6)], "six")
    assert six <= one + 4
