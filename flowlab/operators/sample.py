"""Deterministic, exact, skew-safe stratified sampling and splitting.

Row order inside a class is a seeded hash of the row key (Park–Miller on
integer keys, identical in Spark and DuckDB).  Exact per-class ranks never
use a window over a whole class (one class may hold a third of all rows):
the hash range is cut into buckets, per-(class, bucket) counts give each
bucket its exact rank offset, buckets entirely beyond a quota are dropped
before any sort, and only the surviving rows are ranked inside their
(class, bucket) partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.ordered import global_row_number
from flowlab.sources.tables import park_miller

HASH_RANGE = 2147483647
ROWS_PER_BUCKET = 500_000


def row_hash(key: Column, seed: int = 0) -> Column:
    """Seeded order value in [0, 2^31−1) for an integer key.

    seed 0: PM(key); seed 1: PM(PM(key)); seed s ≥ 2: PM(PM(key) + 7919·s)
    with PM the Park–Miller step — a shallow expression for any seed.
    """
    h = park_miller(key)
    if seed == 1:
        h = park_miller(h)
    elif seed >= 2:
        h = park_miller(h + F.lit(7919 * seed))
    return h


def _class_counts(df: DataFrame, by: str) -> dict:
    # bounded: one row per class
    return {r[0]: int(r[1]) for r in df.groupBy(by).count().collect()}


def _buckets_for(max_rows_in_group: int) -> int:
    return max(1, math.ceil(max_rows_in_group / ROWS_PER_BUCKET))


def ranked_within(df: DataFrame, by: str, key: str, seed: int = 0, quotas: dict | None = None,
                  out: str = "rank_in_class", buckets: int | None = None) -> DataFrame:
    """Exact 1-based rank of each row inside its class by (hash(key), key).

    With ``quotas`` (class → n) only rows of rank ≤ n are returned, and rows
    in hash buckets wholly beyond the quota are discarded before ranking.
    """
    counts = _class_counts(df, by) if buckets is None else None
    nb = buckets or _buckets_for(max(counts.values(), default=1))
    h = row_hash(F.col(key), seed)
    x = df.withColumn("_h", h).withColumn("_b", (F.col("_h") * nb / F.lit(HASH_RANGE)).cast("int"))
    per = x.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = per.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if quotas is not None:
        q = df.sparkSession.createDataFrame([(k, int(v)) for k, v in quotas.items()],
                                            f"{by} {df.schema[by].dataType.simpleString()}, _q long")
        off = off.join(F.broadcast(q), by).where(F.col("_off") < F.col("_q"))
    j = x.join(off.drop("_cnt"), [by, "_b"])
    w = Window.partitionBy(by, "_b").orderBy("_h", key)
    r = j.withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("long"))
    if quotas is not None:
        r = r.where(F.col(out) <= F.col("_q")).drop("_q")
    return r.drop("_h", "_b", "_off")


def stratified_cap(df: DataFrame, by: str, key: str, max_rows: int, seed: int = 0) -> DataFrame:
    """Up to ``max_rows`` rows, each class keeping n_c = max(1, half-even(max·N_c/N)) ≤ N_c;
    if the quotas overshoot (every class keeps ≥ 1) a second hash trims to ``max_rows``."""
    counts = _class_counts(df, by)
    n = sum(counts.values())
    if n <= max_rows:
        return df
    quotas = {c: min(k, max(1, _half_even(max_rows * k / n))) for c, k in counts.items()}
    picked = ranked_within(df, by, key, seed, quotas,
                           buckets=_buckets_for(max(counts.values()))).drop("rank_in_class")
    if sum(quotas.values()) > max_rows:
        g = global_row_number(picked.withColumn("_h2", row_hash(F.col(key), seed + 1)),
                              ["_h2", key], "_g")
        picked = g.where(F.col("_g") <= max_rows).drop("_h2", "_g")
    return picked


def _half_even(x: float) -> int:
    return int(round(x))  # Python's round() is half-to-even, like Spark's bround


def label_budget(df: DataFrame, by: str, key: str, fraction: float, seed: int = 0,
                 min_per_class: int = 1) -> DataFrame:
    """Per class n = min(N_c, max(min_per_class, half-even(N_c·fraction))) rows."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    counts = _class_counts(df, by)
    quotas = {c: min(k, max(min_per_class, _half_even(k * fraction))) for c, k in counts.items()}
    return ranked_within(df, by, key, seed, quotas,
                         buckets=_buckets_for(max(counts.values(), default=1))).drop("rank_in_class")


def stratified_split(df: DataFrame, by: str, key: str, fraction: float = 0.2, seed: int = 0,
                     out: str = "role", a: str = "train", b: str = "validation") -> DataFrame:
    """Disjoint, exhaustive stratified split: half-even(N_c·fraction) rows of each class go to ``b``.

    Rows stay where they are: a row's side follows from its hash, its key and the last ones that its class's quota takes.
    Rows with a null class or key are left out.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be in (0, 1)")
    counts = _class_counts(df, by)
    ends = _quota_ends(df, by, key, seed, {c: _half_even(k * fraction) for c, k in counts.items()}, _buckets_for(max(counts.values(), default=1)))
    x = df.withColumn("_h", row_hash(F.col(key), seed)).where(F.col("_h").isNotNull()).join(F.broadcast(ends), by)  # a row a class
    at_end = (F.col("_h") == F.col("_end_h")) & (F.col(key) == F.col("_end_key"))
    taken = F.coalesce((F.col("_h") < F.col("_end_h")) | (F.col("_h") == F.col("_end_h")) & (F.col(key) <= F.col("_end_key")), F.lit(False))
    x = x.withColumn("_in", taken)
    if ends.where("_some is not null").limit(1).collect():  # a quota ends among rows of one key: just these are numbered
        shared = F.col("_some").isNotNull() & F.coalesce(at_end, F.lit(False))
        numbered = x.where(shared).withColumn("_in", F.row_number().over(Window.partitionBy(by).orderBy("_h", key)) <= F.col("_some"))
        x = x.where(~shared).unionByName(numbered)
    return x.withColumn(out, F.when(F.col("_in"), b).otherwise(a)).drop("_h", "_end_h", "_end_key", "_some", "_in")


def _quota_ends(df: DataFrame, by: str, key: str, seed: int, quotas: dict, nb: int) -> DataFrame:
    """A row a class: hash and key of its quota's last row (null: it takes none), and ``_some``: how many rows of the last
    key it takes where that is not all of them.

    Only class and key are read; of them, just each class's bucket with the last row is sorted.
    """
    h = row_hash(F.col(key), seed)
    x = df.select(by, F.col(key).alias("_key"), h.alias("_h"), (h * nb / F.lit(HASH_RANGE)).cast("int").alias("_b"))
    per = x.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # null keys count first
    kind, key_kind = (df.schema[c].dataType.simpleString() for c in (by, key))
    q = df.sparkSession.createDataFrame([(c, int(v)) for c, v in quotas.items()], f"{by} {kind}, _q long")
    off = per.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).join(F.broadcast(q), by)
    off = off.where((F.col("_off") < F.col("_q")) & (F.col("_q") <= F.col("_off") + F.col("_cnt"))).drop("_cnt")
    w = Window.partitionBy(by).orderBy("_h", "_key")
    ranked = x.join(F.broadcast(off), [by, "_b"]).select(  # a row a class
        by, "_h", "_key", "_q", (F.col("_off") + F.row_number().over(w)).alias("_n"), (F.col("_off") + F.rank().over(w)).alias("_first"),
        F.coalesce(F.lead("_key").over(w) == F.col("_key"), F.lit(False)).alias("_more"))
    last = {str(r[0]): r for r in ranked.where(F.col("_n") == F.col("_q")).collect()}  # as text: NaN is no key of a dict
    rows = []
    for c in quotas:
        r = last.get(str(c))
        rows.append((c, r["_h"], r["_key"], r["_n"] - r["_first"] + 1 if r["_more"] else None) if r else (c, None, None, None))
    return df.sparkSession.createDataFrame(rows, f"{by} {kind}, _end_h long, _end_key {key_kind}, _some long")


def stratified_folds(df: DataFrame, by: str, key: str, k: int = 3, seed: int = 0,
                     out: str = "fold") -> DataFrame:
    """Fold id = (rank in class − 1) mod k: every fold gets ⌊N_c/k⌋ or ⌈N_c/k⌉ rows of each class."""
    r = ranked_within(df, by, key, seed)
    return r.withColumn(out, ((F.col("rank_in_class") - 1) % k).cast("int")).drop("rank_in_class")


def uniform_cap(df: DataFrame, key: str, max_rows: int, seed: int = 0) -> DataFrame:
    """``max_rows`` rows without replacement, chosen by hash order (all rows if fewer)."""
    return (df.withColumn("_h", row_hash(F.col(key), seed)).orderBy("_h", key)
            .limit(max_rows).drop("_h"))


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows by an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def chunk_ids(df: DataFrame, key: str, size: int, out: str = "chunk_id") -> DataFrame:
    """Contiguous chunks of ``size`` rows in key order; the last chunk may be short."""
    if size <= 0:
        raise ValueError("size must be positive")
    g = global_row_number(df, [key], "_rn")
    return g.withColumn(out, F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")
