"""Exact global running totals and row numbers without a one-partition window.

``Window.orderBy(x)`` with no partition moves every row into a single task.
Here the ordering column is first cut into ranges whose boundaries come
from ``approxQuantile`` (the driver sees at most ``buckets`` numbers); each
range gets its exact start offset from a window over the per-range totals
(``buckets`` rows), and only rows of one range are ever sorted together.
Approximate boundaries only change how work is split, never the result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def default_buckets(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(2, 4 * parts)


def range_bucket(df: DataFrame, col: str, out: str = "_rb", buckets: int | None = None,
                 rel_err: float = 1e-3) -> DataFrame:
    """Add ``out`` = index of the value range ``col`` falls into (ascending)."""
    nb = buckets or default_buckets(df)
    num = F.col(col).cast("double")
    probs = [i / nb for i in range(1, nb)]
    tmp = df.select(num.alias("_v")).where(F.col("_v").isNotNull())
    bounds = tmp.approxQuantile("_v", probs, rel_err) if probs else []
    splits = [float("-inf")] + sorted(set(b for b in bounds if b == b)) + [float("inf")]
    withv = df.withColumn("_v", num)
    b = Bucketizer(splits=splits, inputCol="_v", outputCol=out, handleInvalid="keep")
    return b.transform(withv).drop("_v").withColumn(out, F.col(out).cast("int"))


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = True,
                   buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows up to and including this one.

    ``order_col`` must be unique (e.g. the output of ``groupBy(score)``).
    """
    b = range_bucket(df, order_col, "_rb", buckets)
    if descending:
        b = b.withColumn("_rb", -F.col("_rb"))
    totals = b.groupBy("_rb").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    # bounded by the bucket count, so a one-partition window is fine here
    before = Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_rb", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                 for c in sum_cols])
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    within = Window.partitionBy("_rb").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = b.join(F.broadcast(offsets), "_rb")
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_o_{c}") + F.sum(c).over(within)).alias(f"{prefix}{c}") for c in sum_cols])
    return out


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "rn",
                      buckets: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number()`` over the whole table ordered by ``order_cols``.

    The first order column drives the range split; the rest break ties.
    """
    b = range_bucket(df, order_cols[0], "_rb", buckets)
    counts = b.groupBy("_rb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_rb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_rb").orderBy(*order_cols)
    return (b.join(F.broadcast(offsets), "_rb")
            .withColumn(out, F.col("_o") + F.row_number().over(within))
            .drop("_rb", "_o"))


def attach_totals(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row of ``df``.

    An equi-join on a constant key against a broadcast single row: no
    pairing of rows, no shuffle of ``df``.
    """
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], limit: int = 200_000,
                    accuracy: int = 2_000) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles (NumPy/DuckDB ``quantile_cont``) of many columns.

    The order statistics of all columns are searched together.  A round
    brackets every one that is not yet found by a ``percentile_approx`` sketch
    of the rows still in question (one job), and counts the rows below and at
    the bracket's ends (one job); ranks in the tie block of an end resolve to
    that end.  Brackets of at most ``limit`` values are collected at the end
    (one job); larger ones go into the next round, which leaves about
    6 / accuracy of their rows.  The number of jobs depends on the number of
    rows only, memory on neither.  The columns are read once and persisted.
    """
    import math

    x = df.select(*[F.col(c).cast("double").alias(f"q{i}") for i, c in enumerate(cols)]).persist()
    try:
        counts = x.agg(*[F.count(f"q{i}").alias(f"n{i}") for i in range(len(cols))]).first()
        plan = {(i, p): (counts[f"n{i}"] - 1) * p for i in range(len(cols)) for p in probs if counts[f"n{i}"]}
        ranks = {(i, r) for (i, _), h in plan.items() for r in (math.floor(h), math.ceil(h))}
        values = _select_ranks(x, sorted(ranks), {i: counts[f"n{i}"] for i in range(len(cols))}, limit, accuracy)
    finally:
        x.unpersist()

    def at(i: int, p: float) -> float | None:
        if (i, p) not in plan:
            return None
        h = plan[(i, p)]
        low, high = values[(i, math.floor(h))], values[(i, math.ceil(h))]
        return low + (h - math.floor(h)) * (high - low)

    return {c: [at(i, p) for p in probs] for i, c in enumerate(cols)}


def _select_ranks(x: DataFrame, ranks: list[tuple[int, int]], sizes: dict[int, int], limit: int, accuracy: int) -> dict[tuple[int, int], float]:
    """{(column, rank): value} for 0-based ranks among the non-null values of the columns q0, q1, …"""
    found: dict[tuple[int, int], float] = {}
    small: dict[tuple[int, float, float], list[tuple[int, int]]] = {}
    # rank → open bracket (None: no bound), rows below it, rows in it, margin of the sketch
    open_: dict[tuple[int, int], tuple] = {t: (None, None, 0, sizes[t[0]], 3.0 / accuracy) for t in ranks}
    while open_:
        tasks = sorted(open_)

        def inside(t):
            a, b, *_ = open_[t]
            col = F.col(f"q{t[0]}")
            return col if a is None else F.when((col > F.lit(a)) & (col < F.lit(b)), col)

        sketch = []
        for j, t in enumerate(tasks):
            _, _, below, n, margin = open_[t]
            share = (t[1] - below) / max(n - 1, 1)
            ends = F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin)))
            sketch.append(F.percentile_approx(inside(t), ends, accuracy).alias(f"a{j}"))
        got = x.agg(*sketch).first()
        ends = [(float(got[f"a{j}"][0]), float(got[f"a{j}"][1])) for j in range(len(tasks))]
        tally = []
        for j, (t, (a, b)) in enumerate(zip(tasks, ends, strict=True)):
            col = F.col(f"q{t[0]}")
            for k, hit in enumerate((col < a, col <= a, col < b, col <= b)):
                tally.append(F.sum(hit.cast("long")).alias(f"c{j}_{k}"))
        got = x.agg(*tally).first()
        following = {}
        for j, (t, (a, b)) in enumerate(zip(tasks, ends, strict=True)):
            under_a, upto_a, under_b, upto_b = (int(got[f"c{j}_{k}"]) for k in range(4))
            if not under_a <= t[1] < upto_b:  # beyond the sketch's error: again, with a wider margin
                following[t] = (*open_[t][:4], open_[t][4] * 4)
            elif t[1] < upto_a:
                found[t] = a
            elif t[1] >= under_b:
                found[t] = b
            elif under_b - upto_a <= limit:
                small.setdefault((t[0], a, b), []).append((t[1], upto_a))
            else:
                following[t] = (a, b, upto_a, under_b - upto_a, 3.0 / accuracy)
        open_ = following
    if small:
        brackets = sorted(small)
        parts = [F.when((F.col(f"q{i}") > F.lit(a)) & (F.col(f"q{i}") < F.lit(b)), F.struct(F.lit(k).alias("t"), F.col(f"q{i}").alias("v")))
                 for k, (i, a, b) in enumerate(brackets)]
        held: dict[int, list[float]] = {}
        for t, v in x.select(F.explode(F.array_compact(F.array(*parts))).alias("s")).select("s.t", "s.v").collect():  # at most `limit` values a bracket
            held.setdefault(t, []).append(v)
        for k, bracket in enumerate(brackets):
            ordered = sorted(held[k])
            for rank, below in small[bracket]:
                found[(bracket[0], rank)] = ordered[rank - below]
    return found
