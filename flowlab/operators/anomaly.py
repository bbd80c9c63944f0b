"""Normal-only anomaly scoring and the quantile threshold policy.

* k-means distance: MLlib KMeans on normal rows; the score is the distance
  to the nearest centre, computed with the (k × d) centres inlined as
  literals — a projection, no join.
* Isolation forest: every row joins each tree's subsample with probability
  ψ/n (a hash of (key, tree)), so tree t sees ≈ ψ rows; ``groupBy(tree)``
  + ``applyInPandas`` grows all trees in parallel (memory per task bounded by
  ψ); the node tables (≤ T·2ψ rows, independent of n) are broadcast and a
  vectorised ``mapInPandas`` computes path lengths.
* PCA reconstruction error: z-score, MLlib PCA fitted on normal rows,
  error = ‖x − PPᵀx‖².
* Threshold policy: exact train-normal quantile of the score, then
  ``score >= t``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.operators.evaluate import binary_metrics, family_recall


def kmeans_distance(normal: DataFrame, df: DataFrame, k: int = 16, seed: int = 42,
                    features: str = "features", out: str = "score") -> DataFrame:
    """Distance of each row to the nearest k-means centre fitted on ``normal``."""
    model = KMeans(k=k, seed=seed, featuresCol=features).fit(normal)
    centres = [list(map(float, c)) for c in model.clusterCenters()]  # k × d, bounded
    x = vector_to_array(F.col(features))
    dists = [F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)),
                                F.lit(0.0), lambda acc, v: acc + v)) for c in centres]
    return df.withColumn(out, F.least(*dists) if len(dists) > 1 else dists[0])


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def isolation_forest(normal: DataFrame, df: DataFrame, key: str, trees: int = 150,
                     max_samples: int = 10_000, seed: int = 42, features: str = "features",
                     out: str = "score") -> DataFrame:
    """Isolation-forest anomaly score 2^(−E[h(x)]/c(ψ)) (higher = more anomalous)."""
    spark = df.sparkSession
    n = normal.count()
    psi = int(min(max_samples, n))  # the method's own sample size for a tree
    p = min(1.0, psi / max(n, 1))
    height = int(math.ceil(math.log2(max(psi, 2))))
    # each row joins tree t when hash(key, t) < p: ≈ ψ rows per tree
    member = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                      lambda t: (F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1 << 62))
                                 < F.lit(int(p * (1 << 62)))))
    samples = normal.select(F.explode(member).alias("tree"), vector_to_array(features).alias("x"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        X = np.vstack(pdf["x"].to_numpy())
        rng = np.random.default_rng([seed, t])
        rows = []  # node, feature, threshold, left, right, size

        def build(idx, depth):
            node = len(rows)
            rows.append([node, -1, 0.0, -1, -1, len(idx)])
            if depth >= height or len(idx) <= 1:
                return node
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if len(cand) == 0:
                return node
            f = int(rng.choice(cand))
            thr = float(rng.uniform(lo[f], hi[f]))
            left = idx[sub[:, f] < thr]
            right = idx[sub[:, f] >= thr]
            rows[node][1], rows[node][2] = f, thr
            rows[node][3] = build(left, depth + 1)
            rows[node][4] = build(right, depth + 1)
            return node

        build(np.arange(len(X)), 0)
        a = np.array(rows, dtype=object)
        return pd.DataFrame({"tree": t, "node": a[:, 0].astype(int), "feature": a[:, 1].astype(int),
                             "threshold": a[:, 2].astype(float), "left": a[:, 3].astype(int),
                             "right": a[:, 4].astype(int), "size": a[:, 5].astype(int)})

    nodes = samples.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, threshold double, left int, right int, size int")
    table = nodes.orderBy("tree", "node").toPandas()  # ≤ trees·2ψ rows, independent of n
    table["rest"] = table["size"].map(_c)  # mean path length below a leaf
    forest = [g.sort_values("node")[["feature", "threshold", "left", "right", "rest"]].to_numpy()
              for _, g in table.groupby("tree")]
    b = spark.sparkContext.broadcast(forest)
    cpsi = _c(psi)

    def score(it):
        fs = b.value
        for pdf in it:
            X = np.vstack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            total = np.zeros(len(pdf))
            for tr in fs:
                feat, thr = tr[:, 0].astype(int), tr[:, 1].astype(float)
                left, right, rest = tr[:, 2].astype(int), tr[:, 3].astype(int), tr[:, 4].astype(float)
                node = np.zeros(len(pdf), dtype=int)
                depth = np.zeros(len(pdf))
                active = feat[node] >= 0
                while active.any():
                    i = np.flatnonzero(active)
                    go_left = X[i, feat[node[i]]] < thr[node[i]]
                    node[i] = np.where(go_left, left[node[i]], right[node[i]])
                    depth[i] += 1
                    active = feat[node] >= 0
                total += depth + rest[node]
            pdf = pdf.drop(columns=["_x"])
            pdf[out] = np.power(2.0, -(total / max(len(fs), 1)) / cpsi) if cpsi > 0 else 0.5
            yield pdf

    base = df.withColumn("_x", vector_to_array(features)).drop(features)
    fields = [f for f in base.schema.fields if f.name != "_x"]
    schema = T.StructType(fields + [T.StructField(out, T.DoubleType())])
    return base.mapInPandas(score, schema)


def reconstruction_error(normal: DataFrame, df: DataFrame, k: int, features: str = "features",
                         out: str = "score") -> DataFrame:
    """‖x − PPᵀx‖² with P the top-k principal axes of the (z-scored) normal rows."""
    from pyspark.ml.feature import PCA
    model = PCA(k=k, inputCol=features, outputCol="_p").fit(normal)
    # P has orthonormal columns, so ‖x − PPᵀx‖² = ‖x‖² − ‖Pᵀx‖² (Pᵀx is the PCA output)
    sq = lambda c: F.aggregate(vector_to_array(F.col(c)), F.lit(0.0), lambda acc, v: acc + v * v)
    return model.transform(df).withColumn(out, F.greatest(sq(features) - sq("_p"), F.lit(0.0))).drop("_p")


def normal_quantile_threshold(train_scores: DataFrame, q: float, score: str = "score") -> float:
    """Exact (linear-interpolation) quantile of the normal training scores."""
    from flowlab.operators.ordered import exact_quantiles
    return float(exact_quantiles(train_scores, [score], [q])[score][0])


def threshold_policy(train_normal: DataFrame, test: DataFrame, quantiles: list[float],
                     families: list[str], score: str = "score", y: str = "y",
                     family: str = "attack_family") -> DataFrame:
    """Per quantile: threshold, accuracy, macro-F1, normal/attack recall and family recalls."""
    from flowlab.operators.ordered import exact_quantiles
    rows = None
    for q, t in zip(quantiles, exact_quantiles(train_normal, [score], quantiles)[score], strict=True):
        pred = test.withColumn("_p", (F.col(score) >= F.lit(t)).cast("int"))
        mb = binary_metrics(pred, y, "_p").select("accuracy", "macro_f1", "normal_recall", "attack_recall")
        fr = family_recall(pred, families, family, "_p")
        wide = fr.groupBy().pivot("family", families).agg(F.first("recall"))
        wide = wide.select(*[F.col(f).alias(f"family_{f}_recall") for f in families])
        from flowlab.operators.ordered import attach_totals
        r = attach_totals(mb, wide).select(F.lit(q).alias("normal_quantile"), F.lit(t).alias("threshold"), "*")
        rows = r if rows is None else rows.unionByName(r)
    return rows
