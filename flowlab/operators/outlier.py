"""Train-fitted IQR fences and row-level outlier scoring.

Fitting uses exact linear-interpolation quantiles (``ordered.exact_quantiles``:
bounded memory, three scans for all features) or ``percentile_approx`` when
``accuracy`` is given.  The fitted fences are
F small rows; scoring inlines them as literals into higher-order array
expressions, so scoring is a narrow projection: no UDF, no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _quantiles(df: DataFrame, features: list[str], probs: list[float],
               accuracy: int | None) -> dict[str, list[float]]:
    if accuracy is None:
        from flowlab.operators.ordered import exact_quantiles
        return exact_quantiles(df, features, probs)
    exprs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        q = F.percentile_approx(x, F.array(*[F.lit(p) for p in probs]), accuracy)
        exprs.append(q.alias(f"q{i}"))
    row = df.agg(*exprs).first()
    return {c: [None if v is None else float(v) for v in (row[f"q{i}"] or [None] * len(probs))]
            for i, c in enumerate(features)}


def iqr_reference(train: DataFrame, features: list[str], accuracy: int | None = None) -> DataFrame:
    """Per feature: q1, q3, iqr, median, lower_fence, upper_fence (IQR 0 → fences q1/q3)."""
    qs = _quantiles(train, features, [0.25, 0.5, 0.75], accuracy)
    rows = []
    for c in features:
        q1, med, q3 = qs[c]
        iqr = q3 - q1
        lo, hi = (q1, q3) if iqr == 0 else (q1 - 1.5 * iqr, q3 + 1.5 * iqr)
        rows.append((c, q1, q3, iqr, med, lo, hi))
    return train.sparkSession.createDataFrame(
        rows, "feature string, q1 double, q3 double, iqr double, median double, "
              "lower_fence double, upper_fence double")


def outlier_rates(train: DataFrame, features: list[str], accuracy: int | None = None) -> DataFrame:
    """Share of rows outside the fences per feature (IQR 0 → rate 0); strict < / >."""
    ref = iqr_reference(train, features, accuracy).collect()
    exprs = []
    for r in ref:
        x = F.col(r.feature).cast("double")
        hit = (x < F.lit(r.lower_fence)) | (x > F.lit(r.upper_fence))
        rate = F.lit(0.0) if r.iqr == 0 else F.avg(F.coalesce(hit, F.lit(False)).cast("double"))
        exprs.append(F.struct(F.lit(r.feature).alias("feature"), rate.alias("outlier_rate_iqr"),
                              F.lit(r.q1).alias("q1"), F.lit(r.q3).alias("q3"),
                              F.lit(r.lower_fence).alias("lower_fence"),
                              F.lit(r.upper_fence).alias("upper_fence")))
    return train.agg(F.array(*exprs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def score_rows(df: DataFrame, ref: DataFrame | list, features: list[str], top: int = 8) -> DataFrame:
    """Add outlier_feature_count, outlier_feature_fraction, max_abs_robust_z,
    top_outlier_features (top ``top`` hit features by robust z) and ``hits``
    (array of structs feature/value/lower_fence/upper_fence/abs_robust_z).

    Robust z = |x − median| / IQR, with IQR 0 → |x − median|.
    """
    rows = {r.feature: r for r in (ref.collect() if isinstance(ref, DataFrame) else ref)}
    cells = []
    for i, c in enumerate(features):
        r = rows[c]
        x = F.col(c).cast("double")
        z = F.abs(x - F.lit(r.median)) / F.lit(r.iqr if r.iqr != 0 else 1.0)
        hit = F.coalesce((x < F.lit(r.lower_fence)) | (x > F.lit(r.upper_fence)), F.lit(False))
        cells.append(F.struct(hit.alias("hit"), F.lit(i).alias("idx"), F.lit(c).alias("feature"),
                              x.alias("value"), F.lit(r.lower_fence).alias("lower_fence"),
                              F.lit(r.upper_fence).alias("upper_fence"), z.alias("abs_robust_z")))
    hits = F.filter(F.array(*cells), lambda s: s["hit"])
    # order: robust z descending, then later feature first (a reversed stable argsort)
    ordered = F.array_sort(hits, lambda a, b: F.when(a["abs_robust_z"] > b["abs_robust_z"], -1)
                           .when(a["abs_robust_z"] < b["abs_robust_z"], 1)
                           .otherwise(b["idx"] - a["idx"]))
    out = df.withColumn("hits", ordered)
    n = F.size("hits")
    return out.select(
        "*", n.alias("outlier_feature_count"),
        (n / F.lit(float(len(features)))).alias("outlier_feature_fraction"),
        F.coalesce(F.array_max(F.transform("hits", lambda s: s["abs_robust_z"])), F.lit(0.0))
        .alias("max_abs_robust_z"),
        F.array_join(F.transform(F.slice("hits", 1, top), lambda s: s["feature"]), ", ")
        .alias("top_outlier_features"))


def hit_table(scored_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long (key…, feature, value, fences, abs_robust_z) table: one row per hit."""
    return scored_rows.select(*keys, F.explode("hits").alias("h")).select(
        *keys, "h.feature", "h.value", "h.lower_fence", "h.upper_fence", "h.abs_robust_z")


def feature_frequency(long: DataFrame, split: str = "split") -> DataFrame:
    """Hit rows and mean robust z per (split, feature)."""
    return long.groupBy(split, "feature").agg(
        F.count(F.lit(1)).alias("outlier_rows"), F.avg("abs_robust_z").alias("mean_abs_robust_z"))


def hit_histogram(scored_rows: DataFrame, cls: str = "binary_label") -> DataFrame:
    """Rows per (class, hit count) and the density within each class."""
    c = scored_rows.groupBy(F.col(cls).alias("class"), "outlier_feature_count").agg(
        F.count(F.lit(1)).alias("rows"))
    return c.withColumn("density", F.col("rows") / F.sum("rows").over(Window.partitionBy("class")))


def top_rows(scored_rows: DataFrame, keys: list[str], n: int = 30) -> DataFrame:
    """Multi-key top-n: most hit features, then largest robust z, then key."""
    return scored_rows.orderBy(F.col("outlier_feature_count").desc(),
                               F.col("max_abs_robust_z").desc(), *keys).limit(n)


def first_n_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """``row_number() <= n`` per group.  Spark plans this as a WindowGroupLimit
    that keeps ≤ n rows per group in each partition *before* the shuffle, so a
    hot group never ships all of its rows to one task."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= n)


def top_row_heatmap(scored_rows: DataFrame, keys: list[str], top_n: int = 40,
                    top_features: int = 25) -> DataFrame:
    """log1p(max robust z) pivot of the top rows × their most frequent hit features.

    The top rows are a bounded list (``top_n``), joined back by key (inner)
    to the long hit table; features are restricted with a semi join to the
    ``top_features`` most common among those rows; missing cells are 0.
    """
    top = top_rows(scored_rows, keys, top_n).select(*keys)
    long = hit_table(scored_rows, keys).join(F.broadcast(top), keys, "inner")
    common = (long.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
              .orderBy(F.col("_n").desc(), "feature").limit(top_features))
    long = long.join(F.broadcast(common.select("feature")), "feature", "left_semi")
    names = [r.feature for r in common.select("feature").collect()]  # ≤ top_features names
    pv = top.join(long.groupBy(*keys).pivot("feature", names).agg(F.max("abs_robust_z")), keys, "left")
    pv = pv.na.fill(0.0, names)
    return pv.select(*keys, *[F.log1p(F.col(f"`{c}`")).alias(c) for c in names])
