"""Leakage-safe preprocessing: statistics fitted on train only, applied anywhere.

``fit`` runs one aggregation over the training rows and keeps only bounded
statistics on the driver (vocabularies, means, standard deviations,
medians).  ``apply`` is then a single narrow projection — one-hot
comparisons and affine maps, all JVM expressions inside whole-stage
codegen — so transforming train, test or a stream never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.ordered import attach_totals
from flowlab.operators.quality import nan_to_null
from flowlab.session import cut_lineage, store


@dataclass
class FittedPrep:
    categorical: list[str]
    numeric: list[str]
    vocab: dict[str, list[str]] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    median: dict[str, float] = field(default_factory=dict)

    def feature_names(self) -> list[str]:
        """One-hot names ``<column>_<value>`` in vocabulary order, then numeric names."""
        return [f"{c}_{v}" for c in self.categorical for v in self.vocab[c]] + list(self.numeric)

    def columns(self, df: DataFrame) -> list[Column]:
        out = []
        for c in self.categorical:
            x = F.col(c).cast("string")
            # values outside the train vocabulary match no column: an all-zero block
            out += [F.coalesce((x == F.lit(v)), F.lit(False)).cast("double").alias(f"{c}_{v}")
                    for v in self.vocab[c]]
        for c in self.numeric:
            x = F.col(c).cast("double")
            if c in self.median:
                bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
                x = F.coalesce(F.when(bad, None).otherwise(x), F.lit(self.median[c]))
            sd = self.std.get(c) or 1.0  # sklearn: a zero scale becomes 1
            out.append(((x - F.lit(self.mean[c])) / F.lit(sd)).alias(c))
        return out

    def apply(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Transformed columns only (plus ``keep``): everything undeclared is dropped."""
        return df.select(*(keep or []), *self.columns(df))

    def apply_vector(self, df: DataFrame, keep: list[str] | None = None,
                     out: str = "features") -> DataFrame:
        wide = self.apply(df, keep)
        names = self.feature_names()
        va = VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep")
        return va.transform(wide).select(*(keep or []), out)


def fit(train: DataFrame, categorical: list[str], numeric: list[str],
        impute_median: bool = False, max_vocab: int = 100_000) -> FittedPrep:
    """Fit vocabularies (sorted distinct train values), means and population stds.

    With ``impute_median`` ±Inf/NaN become null and nulls take the exact train
    median before scaling (the statistics are computed on imputed values).
    """
    fp = FittedPrep(list(categorical), list(numeric))
    src = nan_to_null(train, [c for c in numeric]) if impute_median else train
    for c in categorical:
        vals = (src.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct()
                .orderBy("v").limit(max_vocab + 1).collect())
        if len(vals) > max_vocab:
            raise ValueError(f"{c}: more than {max_vocab} categories make no dense block; use fit_sparse")
        fp.vocab[c] = [r.v for r in vals]
    if impute_median and numeric:
        from flowlab.operators.ordered import exact_quantiles
        med = exact_quantiles(src, numeric, [0.5])
        fp.median = {c: (float(med[c][0]) if med[c][0] is not None else 0.0) for c in numeric}
        src = src.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fp.median[c])).alias(c)
                           for c in numeric])
    if numeric:
        st = src.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(numeric)],
                     # a constant column has deviation 0, whatever rounding makes of its sums
                     *[F.when(F.min(F.col(c).cast("double")) == F.max(F.col(c).cast("double")), 0.0)
                       .otherwise(F.stddev_pop(F.col(c).cast("double"))).alias(f"s_{i}") for i, c in enumerate(numeric)]).first()
        for i, c in enumerate(numeric):
            fp.mean[c] = float(st[f"m_{i}"]) if st[f"m_{i}"] is not None else 0.0
            fp.std[c] = float(st[f"s_{i}"]) if st[f"s_{i}"] is not None else 0.0
    return fp


def vocabulary(train: DataFrame, categorical: list[str]) -> DataFrame:
    """(column, value, position) of the sorted distinct train values: positions count on over the columns, in their order.

    Of any size: values are sorted by range, and numbered by the sizes of the
    ranges before theirs.
    """
    order = F.create_map(*[F.lit(x) for i, c in enumerate(categorical) for x in (c, i)])
    values = (train.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], categorical, "column", "value")
              .where("value IS NOT NULL").distinct())
    dealt = values.withColumn("_c", order[F.col("column")]).repartitionByRange("_c", "value").withColumn("_p", F.spark_partition_id())
    dealt = cut_lineage(dealt)  # the ranges must not be drawn anew between the two uses
    sizes = dealt.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_c", "value"))
    return dealt.join(F.broadcast(offsets), "_p").select("column", "value", (F.col("_o") + rank - 1).alias("position"))


@dataclass
class SparsePrep(Transformer):
    """Fitted one-hot and z-score preparation for vocabularies of any size: ``transform`` adds a sparse vector ``features``.

    The vocabulary is a stored table, joined a column at a time (the planner
    broadcasts a small one and splits hot values of a large one); a row's
    positions become one sparse vector.  Its column has no attribute names:
    MLlib's encoder and assembler make an object a category on the driver.
    Values outside the train vocabulary and nulls have no one.  Numeric
    columns follow the blocks.
    """
    categorical: list[str]
    numeric: list[str]
    vocab: DataFrame
    sizes: dict[str, int]
    stats: dict[str, tuple[float, float]]

    def __post_init__(self):
        super().__init__()

    def indexed(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<column>_position``, the place of its value in the column's block; null where it has none."""
        for c in self.categorical:
            own = self.vocab.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("place").alias(f"{c}_position"))
            df = df.join(own, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
        return df

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        used = [c for c in self.categorical if self.sizes[c]]
        out = self.indexed(df)
        starts = dict(zip(used, accumulate([0, *(self.sizes[c] for c in used)]), strict=False))
        first = sum(self.sizes[c] for c in used)  # of the numeric columns
        size = first + len(self.numeric)

        def vector(ones, scaled):
            cells = [(i, 1.0) for i in ones if i is not None] + [(first + i, x) for i, x in enumerate(scaled) if x != 0]
            return Vectors.sparse(size, cells)

        ones = F.array(*[F.col(f"{c}_position") + F.lit(starts[c]) for c in used]).cast("array<long>")
        scaled = F.array(*[F.coalesce((F.col(c).cast("double") - F.lit(self.stats[c][0])) / F.lit(self.stats[c][1] or 1.0), F.lit(0.0))
                           for c in self.numeric]).cast("array<double>")
        return out.select(*keep, F.udf(vector, VectorUDT())(ones, scaled).alias("features"))


def fit_sparse(train: DataFrame, categorical: list[str], numeric: list[str]) -> SparsePrep:
    """Fit ``SparsePrep``: the vocabulary stays a table, the driver holds a size a column and two numbers a numeric one."""
    vocab = vocabulary(train, categorical)
    starts = vocab.groupBy("column").agg(F.min("position").alias("start"), F.count("*").alias("n"))
    rows = {r.column: r for r in starts.collect()}  # a row a column
    first = F.create_map(*[F.lit(x) for c, r in rows.items() for x in (c, r.start)]) if rows else F.lit(0)
    placed = vocab.withColumn("place", F.col("position") - first[F.col("column")]) if rows else vocab.withColumn("place", F.lit(0))
    plain = fit(train, [], numeric)
    return SparsePrep(list(categorical), list(numeric), store(placed), {c: rows[c].n if c in rows else 0 for c in categorical},
                      {c: (plain.mean[c], plain.std[c]) for c in numeric})


def one_hot_sparse(df: DataFrame, key: str, categorical: list[str], vocab: DataFrame) -> DataFrame:
    """(key, positions): the sorted positions of a row's ones; values outside the vocabulary have none.

    ``key`` is unique.  The sparse form of the one-hot blocks, by a join, for vocabularies of any size.
    """
    cells = (df.select(key, *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([key], categorical, "column", "value")
             .join(vocab, ["column", "value"], "left"))
    return cells.groupBy(key).agg(F.sort_array(F.collect_list("position")).alias("positions"))


def zscore_stats(train: DataFrame, numeric: list[str]) -> DataFrame:
    """Train mean and population std per numeric feature (the scaler's fitted state)."""
    structs = [F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias("mean"),
                        F.stddev_pop(F.col(c).cast("double")).alias("std")) for c in numeric]
    return train.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def column_totals(df: DataFrame, names: list[str], chunk: int = 200) -> DataFrame:
    """(feature, total) sums of many columns, in ⌈len/200⌉ wide aggregations."""
    rows = []
    for i in range(0, len(names), chunk):
        part = names[i:i + chunk]
        r = df.agg(*[F.sum(F.col(f"`{n}`")).alias(f"c{j}") for j, n in enumerate(part)]).first()
        rows += [(n, float(r[f"c{j}"]) if r[f"c{j}"] is not None else None) for j, n in enumerate(part)]
    return df.sparkSession.createDataFrame(rows, "feature string, total double")


def max_normalise(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """coalesce(x, 0) / max; a non-positive max gives 0 everywhere."""
    o = out or f"{col}_norm"
    x = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    mx = df.agg(F.max(x).alias("_mx"))
    return attach_totals(df, mx).withColumn(
        o, F.when(F.col("_mx") <= 0, F.lit(0.0)).otherwise(x / F.col("_mx"))).drop("_mx")


def minmax_scores(df: DataFrame, col: str = "score", out: str = "score01") -> DataFrame:
    """(s − min) / max(max − min, 1e-12): decision scores rescaled to [0, 1]."""
    mm = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return attach_totals(df, mm).withColumn(
        out, (F.col(col) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))
    ).drop("_lo", "_hi")
