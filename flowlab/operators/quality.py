"""Data-quality audit, class counts and per-column profiles.

Scale notes
-----------
* Column statistics come from one wide aggregation per pass (no
  ``count_distinct`` over many columns: Spark would expand every row once
  per column).
* Constancy is decided from min/max and null counts.
* Near-constancy (top value share > 99.9 %) is exact in two passes: if a
  value holds more than 99.9 % of the non-null rows it must be the
  approximate median (rank error 1e-4), so pass one finds that candidate per
  column and pass two counts its share exactly.
* Duplicate rows need a shuffle on all columns (``groupBy(all)``); map-side
  partial aggregation collapses hot duplicates before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEAR_CONSTANT_SHARE = 0.999


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _isinf(c: Column) -> Column:
    return c.isin(float("inf"), float("-inf"))


def nan_to_null(df: DataFrame, cols: list[str] | None = None, infinite: bool = True) -> DataFrame:
    """NaN and, with ``infinite``, ±Inf → NULL in floating columns (run *after* auditing them)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = {c: F.isnan(c) | _isinf(F.col(c)) if infinite else F.isnan(c) for c in cols}
    return df.withColumns({c: F.when(bad[c], None).otherwise(F.col(c)) for c in cols}) if cols else df


def column_quality(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: missing, infinite, distinct-free constancy and top-value share.

    Columns: feature, missing, inf, is_constant, is_near_constant,
    dominant_share — the exact share of the top value when one value holds
    more than 99.9 % of the non-null rows (constant columns included), else null.
    """
    df = nan_to_null(df, [c for c in features if _is_numeric(df, c)], infinite=False)  # NaN is missing in every figure
    texts = [c for c in features if not _is_numeric(df, c)]
    top = {}
    if texts:  # the most frequent string of each column (ties: the least)
        counts = unpivot_strings(df, texts, []).where(F.col("value").isNotNull()).groupBy("feature", "value").count()
        top = {r.feature: r.value for r in counts.groupBy("feature").agg(
            F.min(F.struct(-F.col("count"), "value"))["value"].alias("value")).collect()}
    aggs = []
    for i, c in enumerate(features):
        col = F.col(c)
        null = col.isNull()
        aggs += [F.sum(null.cast("long")).alias(f"m{i}"),
                 (F.sum(_isinf(col).cast("long")) if _is_numeric(df, c) else F.lit(0).cast("long"))
                 .alias(f"i{i}"),
                 F.min(col).cast("string").alias(f"lo{i}"), F.max(col).cast("string").alias(f"hi{i}"),
                 F.count(col).alias(f"n{i}"),
                 (F.percentile_approx(col, 0.5, 10000) if _is_numeric(df, c)
                  else F.lit(top.get(c))).cast("string").alias(f"v{i}")]
    first = df.agg(*aggs).first()
    # pass two: exact share of each candidate value (one more wide aggregation)
    shares = []
    for i, c in enumerate(features):
        v = first[f"v{i}"]
        if v is None:
            shares.append(F.lit(None).cast("long").alias(f"s{i}"))
        else:
            shares.append(F.sum((F.col(c).cast("string") == F.lit(v)).cast("long")).alias(f"s{i}"))
    second = df.agg(*shares).first()
    rows = []
    for i, c in enumerate(features):
        n_nonnull = first[f"n{i}"]
        missing = first[f"m{i}"]
        total_distinct_le1 = (n_nonnull == 0) or (first[f"lo{i}"] == first[f"hi{i}"] and missing == 0)
        share = (second[f"s{i}"] / n_nonnull) if (n_nonnull and second[f"s{i}"] is not None) else None
        if share is not None and share <= NEAR_CONSTANT_SHARE:
            share = None  # no dominant value: the candidate's share is not the top share
        near = (not total_distinct_le1) and share is not None
        rows.append((c, int(missing), int(first[f"i{i}"]), bool(total_distinct_le1), bool(near),
                     float(share) if share is not None else None))
    return df.sparkSession.createDataFrame(
        rows, "feature string, missing long, inf long, is_constant boolean, "
              "is_near_constant boolean, dominant_share double")


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: ``duplicate_rows`` = n − distinct rows over ``cols`` (all by default)."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                 F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("rows"))


def quality_audit(df: DataFrame, features: list[str], category: str | None = "attack_category",
                  binary: str | None = "binary_label", benign: str = "Benign") -> DataFrame:
    """One summary row: rows, features, missing/inf cells, duplicates (and %),
    constant and near-constant counts, category/binary consistency mismatches."""
    cq = column_quality(df, features)
    dup = duplicate_rows(df)
    extra = []
    if category and binary:
        bad = (F.col(category) == F.lit(benign)) != (F.col(binary) == 0)
        extra = [F.sum(bad.cast("long")).alias("consistency_mismatches")]
    else:
        extra = [F.lit(0).cast("long").alias("consistency_mismatches")]
    cons = df.agg(*extra)
    summ = cq.agg(F.sum("missing").alias("missing_cells"), F.sum("inf").alias("inf_cells"),
                  F.sum(F.col("is_constant").cast("long")).alias("constant_features"),
                  F.sum(F.col("is_near_constant").cast("long")).alias("near_constant_features"))
    row = {**summ.first().asDict(), **dup.first().asDict(), **cons.first().asDict()}
    n = row["rows"]
    return df.sparkSession.createDataFrame([(
        int(n), len(features), int(row["missing_cells"]), int(row["inf_cells"]),
        int(row["duplicate_rows"]), (row["duplicate_rows"] / n * 100.0) if n else 0.0,
        int(row["constant_features"]), int(row["near_constant_features"]),
        int(row["consistency_mismatches"] or 0))],
        "rows long, features int, missing_cells long, inf_cells long, duplicate_rows long, "
        "duplicate_pct double, constant_features long, near_constant_features long, "
        "consistency_mismatches long")


def class_counts(df: DataFrame, col: str, classes: list[str]) -> DataFrame:
    """Counts over a fixed class domain (absent → 0) and shares, in domain order."""
    dim = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(classes)],
                                          f"class_order int, {col} string")
    cnt = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    j = dim.join(cnt, col, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    tot = j.agg(F.sum("n").alias("_tot"))
    from flowlab.operators.ordered import attach_totals
    return attach_totals(j, tot).select(
        "class_order", col, "n",
        F.when(F.col("_tot") == 0, 0.0).otherwise(F.col("n") / F.col("_tot")).alias("share"))


def phase1_summary(df: DataFrame, features: list[str], label: str = "label",
                   category: str = "attack_category", categories: list[str] | None = None
                   ) -> DataFrame:
    """rows, n_features, n_fine_labels, n_categories (non-empty among the declared ones)."""
    cats = categories
    cat_ok = F.col(category).isin(*cats) if cats else F.col(category).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.lit(len(features)).alias("n_features"),
                  F.count_distinct(label).alias("n_fine_labels"),
                  F.count_distinct(F.when(cat_ok, F.col(category))).alias("n_categories"))


def numeric_profile(df: DataFrame, features: list[str], accuracy: int | None = None) -> DataFrame:
    """Per feature: mean, sample std, min, median, max, missing rate.

    The median is exact (``ordered.exact_quantiles``: sketch, count, collect
    only the bracketed values) unless ``accuracy`` asks for ``percentile_approx``.
    """
    exact = {}
    if accuracy is None:
        from flowlab.operators.ordered import exact_quantiles
        exact = exact_quantiles(df, features, [0.5])  # bounded-memory exact medians
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        med = (F.lit(exact[c][0]) if accuracy is None else F.percentile_approx(x, 0.5, accuracy))
        aggs.append(F.struct(F.lit(c).alias("feature"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                             med.cast("double").alias("median"), F.max(x).alias("max"),
                             F.avg(x.isNull().cast("double")).alias("missing_rate")).alias(f"s{i}"))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(features))])).alias("s")
                       ).select("s.*")


def unpivot_strings(df: DataFrame, cols: list[str], ids: list[str],
                    key: str = "feature", value: str = "value") -> DataFrame:
    """Long (ids…, feature, value-as-string) view of ``cols``."""
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        ids, cols, key, value)


def attribute_profile(df: DataFrame, features: list[str], split: str = "split",
                      approx: bool = False) -> DataFrame:
    """Missing rate and number of unique non-null values per (split, feature).

    Exact uniques: unpivot + a count a value, in one pass (partial aggregation
    before the shuffle); ``approx=True`` uses HyperLogLog in one wide pass instead.
    """
    if approx:
        aggs = [F.struct(F.lit(c).alias("feature"),
                         F.avg(F.col(c).isNull().cast("double")).alias("missing_rate"),
                         F.approx_count_distinct(c).cast("long").alias("unique")).alias(f"s{i}")
                for i, c in enumerate(features)]
        return df.groupBy(split).agg(*aggs).select(
            split, F.explode(F.array(*[f"s{i}" for i in range(len(features))])).alias("s")
        ).select(split, "s.*")
    counts = unpivot_strings(df, features, [split]).groupBy(split, "feature", "value").count()  # the rows are read once
    known = F.col("value").isNotNull() & F.col(split).isNotNull()
    return counts.groupBy(split, "feature").agg(
        (F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).cast("double") / F.sum("count")).alias("missing_rate"),
        F.count(F.when(known, 1)).alias("unique"))


def crosstab_share(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Row-normalised crosstab with fixed column values, rows ordered by frequency."""
    pv = df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
    pv = pv.na.fill(0, values)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return pv.select(row, total.cast("long").alias("rows"),
                     *[(F.col(f"`{v}`") / F.greatest(total, F.lit(1))).alias(v) for v in values])
