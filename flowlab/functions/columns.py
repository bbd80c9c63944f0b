"""Column functions: activations, softmax, losses, safe casts, ids, rounding.

All are plain ``Column -> Column`` expressions (JVM-side, codegen'd); the
aggregating ones (losses, gradient) are ordinary aggregate expressions, so a
full-table gradient is one partial-aggregated pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def activations(x: Column) -> list[Column]:
    """linear, sigmoid, tanh, relu, leaky relu (0.01), elu, gelu (tanh form) and derivatives."""
    s = sigmoid(x)
    t = F.tanh(x)
    gelu = F.lit(0.5) * x * (F.lit(1.0) + F.tanh(F.lit(math.sqrt(2 / math.pi))
                                                 * (x + F.lit(0.044715) * F.pow(x, 3))))
    pos = x > 0
    return [
        x.alias("linear"), F.lit(1.0).alias("linear_derivative"),
        s.alias("sigmoid"), (s * (F.lit(1.0) - s)).alias("sigmoid_derivative"),
        t.alias("tanh"), (F.lit(1.0) - t * t).alias("tanh_derivative"),
        F.greatest(F.lit(0.0), x).alias("relu"), pos.cast("double").alias("relu_derivative"),
        F.when(pos, x).otherwise(F.lit(0.01) * x).alias("leaky_relu"),
        F.when(pos, F.lit(1.0)).otherwise(F.lit(0.01)).alias("leaky_relu_derivative"),
        F.when(pos, x).otherwise(F.exp(x) - F.lit(1.0)).alias("elu"),
        F.when(pos, F.lit(1.0)).otherwise(F.exp(x)).alias("elu_derivative"),
        gelu.alias("gelu"),
    ]


def softmax(logits: Column) -> Column:
    """Numerically stable softmax of an array column (shift by the max)."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda v: F.exp(v - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / total)


def central_difference(df: DataFrame, f: str, order: str, step: float,
                       partition: list[str] | None = None, out: str | None = None) -> DataFrame:
    """np.gradient on a uniform grid: central inside, one-sided at both ends."""
    w = Window.partitionBy(*(partition or [])).orderBy(order)
    prev, nxt = F.lag(f).over(w), F.lead(f).over(w)
    h = F.lit(float(step))
    d = (F.when(prev.isNull() & nxt.isNull(), F.lit(None).cast("double"))
         .when(prev.isNull(), (nxt - F.col(f)) / h)
         .when(nxt.isNull(), (F.col(f) - prev) / h)
         .otherwise((nxt - prev) / (F.lit(2.0) * h)))
    return df.withColumn(out or f"{f}_derivative", d)


def bce_step(df: DataFrame, features: list[str], y: str, w: list[float], bias: float,
             lr: float = 0.1) -> DataFrame:
    """One full-table gradient step of a sigmoid neuron under binary cross-entropy.

    loss = mean(−(y·log(p+ε) + (1−y)·log(1−p+ε))), dL/dz = p − y; returns the
    loss, gradients and the updated parameters in one row (one aggregation).
    """
    z = sum((F.col(c).cast("double") * F.lit(float(wi)) for c, wi in zip(features, w)), F.lit(bias))
    p = sigmoid(z)
    yy = F.col(y).cast("double")
    loss = -(yy * F.log(p + F.lit(EPS)) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - p + F.lit(EPS)))
    aggs = [F.avg(loss).alias("loss"), F.avg(p - yy).alias("grad_b")]
    aggs += [F.avg((p - yy) * F.col(c).cast("double")).alias(f"grad_w{i}") for i, c in enumerate(features)]
    g = df.agg(*aggs)
    return g.select("loss", *[F.col(f"grad_w{i}") for i in range(len(features))], "grad_b",
                    *[(F.lit(float(wi)) - F.lit(lr) * F.col(f"grad_w{i}")).alias(f"w{i}_next")
                      for i, wi in enumerate(w)],
                    (F.lit(bias) - F.lit(lr) * F.col("grad_b")).alias("b_next"))


def binary_losses(df: DataFrame, p: str, y: str, weights: dict[int, float] | None = None,
                  smoothing: float = 0.1, gamma: float = 2.0) -> DataFrame:
    """Cross-entropy family evaluated on a positive-class probability column.

    ce: mean −log p_y; weighted_ce: Σ w_y·ce / Σ w_y; smoothed_ce: (1−ε)·ce +
    ε·mean_k(−log p_k); focal: mean((1 − exp(−w_y·ce))^γ · w_y·ce) — the focal
    term is taken after weighting.  Probabilities are clipped to [1e-12, 1−1e-12].
    """
    pp = F.least(F.greatest(F.col(p).cast("double"), F.lit(EPS)), F.lit(1.0 - EPS))
    yy = F.col(y).cast("int")
    py = F.when(yy == 1, pp).otherwise(F.lit(1.0) - pp)
    ce = -F.log(py)
    wts = weights or {0: 1.0, 1: 1.0}
    wy = F.when(yy == 1, F.lit(float(wts[1]))).otherwise(F.lit(float(wts[0])))
    mean_k = (-F.log(pp) - F.log(F.lit(1.0) - pp)) / F.lit(2.0)
    wce = wy * ce
    focal = F.pow(F.lit(1.0) - F.exp(-wce), F.lit(gamma)) * wce
    return df.agg(F.avg(ce).alias("ce"), (F.sum(wce) / F.sum(wy)).alias("weighted_ce"),
                  F.avg(F.lit(1.0 - smoothing) * ce + F.lit(smoothing) * mean_k).alias("smoothed_ce"),
                  F.avg(focal).alias("focal"))


def safe_float(x: Column) -> Column:
    """NaN / ±Inf → null."""
    d = x.cast("double")
    return F.when(F.isnan(d) | d.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(d)


def stable_id(*parts: Column) -> Column:
    """First 16 hex chars of SHA-256 of the parts joined by ``::``."""
    return F.substring(F.sha2(F.concat_ws("::", *[p.cast("string") for p in parts]), 256), 1, 16)


def half_even(x: Column, scale: int = 0) -> Column:
    return F.bround(x, scale)


def first_float(text: Column) -> Column:
    """First decimal number inside a string, else null."""
    hit = F.regexp_extract(text.cast("string"), r"[-+]?\d*\.?\d+", 0)
    return F.when(hit == "", F.lit(None).cast("double")).otherwise(hit.try_cast("double"))


def coerce_double(text: Column) -> Column:
    """Strict numeric coercion of a string after trimming; bad values → null."""
    return F.trim(text.cast("string")).try_cast("double")


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def balanced_weights(df: DataFrame, label: str, n_classes: int | None = None) -> DataFrame:
    """n / (K · n_c) per class (absent classes use a count of 1, so weights stay finite)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    k = n_classes
    if k is None:
        dom = counts.select(label)
    else:
        dom = df.sparkSession.range(k).select(F.col("id").cast("int").alias(label))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    kk = F.lit(float(k)) if k is not None else F.count(F.lit(1)).over(Window.partitionBy())
    j = dom.join(counts, label, "left")
    from flowlab.operators.ordered import attach_totals
    j = attach_totals(j, total)
    return j.select(label, F.coalesce("n_c", F.lit(0)).cast("long").alias("n_c"),
                    (F.col("_n") / (kk * F.greatest(F.coalesce("n_c", F.lit(0)), F.lit(1))))
                    .alias("weight"))
