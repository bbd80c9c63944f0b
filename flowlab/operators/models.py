"""Supervised models on a ``features`` vector column, and model-level jobs.

Estimators are Spark MLlib's (distributed training); the helpers here only
translate the study's settings (class weights, sklearn's C, depth/leaf
limits) and turn predictions into the shared evaluation tables.  Every
metric goes through ``flowlab.operators.evaluate``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import PCA, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.functions.columns import balanced_weights
from flowlab.operators import evaluate as E
from flowlab.operators.boosting import BoostedModel, SoftmaxBooster
from flowlab.operators.forest import Forest, ForestModel
from flowlab.operators.net import WeightedNet
from flowlab.operators.sample import row_hash, stratified_folds, stratified_split
from flowlab.session import cut_lineage, drop, store


@dataclass
class Data:
    """A prepared table: ``features`` (vector), ``label`` (double class code), ``split``."""
    df: DataFrame
    classes: list[str]
    key: str = "id"

    @property
    def train(self) -> DataFrame:
        return self.df.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.df.where(F.col("split") == "test")


def with_weights(df: DataFrame, label: str = "label", out: str = "weight", fitted: DataFrame | None = None) -> DataFrame:
    """Attach balanced class weights n/(K·n_c), counted over the rows that are fitted (``fitted``, default ``df``).

    A K-row broadcast join; a class without a fitted row gets weight 1.
    """
    w = balanced_weights(df if fitted is None else fitted, label, None).select(F.col(label).alias("_l"), F.col("weight").alias("_w"))
    joined = df.drop(out).join(F.broadcast(w), F.col(label) == F.col("_l"), "left").drop("_l")
    return joined.withColumn(out, F.coalesce("_w", F.lit(1.0))).drop("_w")


def _reg(c: float, train: DataFrame, weight: str | None) -> float:
    """sklearn's C multiplies the summed loss, Spark averages it: regParam = 1/(C·Σw)."""
    tot = train.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
    return 1.0 / (c * float(tot))


def logistic(train: DataFrame, c: float = 1.0, balanced: bool = False, l1_ratio: float = 0.0,
             max_iter: int = 200) -> LogisticRegression:
    w = "weight" if balanced else None
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter,
                            regParam=_reg(c, train, w), elasticNetParam=l1_ratio, standardization=False)
    if w:
        lr.setWeightCol(w)
    return lr


class _TreeParams(Params):
    numTrees = Param(Params._dummy(), "numTrees", "trees of the forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below a tree's root", TypeConverters.toInt)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)


class Trees(Estimator, _TreeParams):
    """``Forest``, or ``SoftmaxBooster`` with trees of a depth, as an estimator of pyspark.ml.

    MLlib's forests hold every node as an object on the driver, 1 GB of counts in a task and take a job a level and batch of
    nodes; Forest holds some 16 bytes a node and grows small nodes in one job.
    """

    def __init__(self, made: Forest | SoftmaxBooster):
        super().__init__()
        self.made = made
        self._set(numTrees=made.trees if isinstance(made, Forest) else made.rounds, maxDepth=made.depth)

    def _fit(self, dataset: DataFrame) -> "TreesModel":
        trees, depth = self.getOrDefault(self.numTrees), self.getMaxDepth()
        if isinstance(self.made, Forest):
            classes = dataset.agg(F.max("label")).first()[0]
            made = replace(self.made, trees=trees, depth=depth, classes=2 if classes is None else max(2, int(classes) + 1))
        else:
            made = replace(self.made, rounds=trees, depth=depth, leaves=1 << depth)
        return TreesModel(made.fit(dataset), trees, depth)


class TreesModel(Model, _TreeParams):
    def __init__(self, model: ForestModel | BoostedModel, trees: int, depth: int):
        super().__init__()
        self.model = model
        self._set(numTrees=trees, maxDepth=depth)

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    @property
    def importances(self) -> np.ndarray:
        return self.model.importances()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset)


def decision_tree(balanced: bool = True, depth: int = 18, min_leaf: int = 3, seed: int = 42):
    # the counts of a task's node batch lie in its executor's heap, beside those of its other tasks
    t = DecisionTreeClassifier(featuresCol="features", labelCol="label", maxDepth=min(depth, 30),
                               minInstancesPerNode=min_leaf, seed=seed, maxMemoryInMB=256,
                               cacheNodeIds=True)
    return t.setWeightCol("weight") if balanced else t


def random_forest(trees: int = 120, depth: int = 18, min_leaf: int = 3, balanced: bool = True,
                  seed: int = 42, key: str | list[str] = "id") -> Trees:
    """Bootstrap forest by row ``key``, the square root of the features a node, rounded up as MLlib does."""
    return Trees(Forest(2, trees, min(depth, 30), min_leaf, "best", bootstrap=True, weights="column" if balanced else None, per_node=0, seed=seed, key=key, least_gain=0.0))


def extra_trees(k: int, trees: int = 120, depth: int = 18, min_leaf: int = 3, balanced: bool = True, seed: int = 42) -> Forest:
    """One random cut a node and drawn feature, on all rows."""
    return Forest(k, trees, depth, min_leaf, "extra", weights="balanced" if balanced else None, seed=seed)


def subsample_forest(k: int, trees: int = 120, depth: int = 18, min_leaf: int = 3, seed: int = 42) -> Forest:
    """Bootstrap forest whose class weights are those of each tree's own sample."""
    return Forest(k, trees, depth, min_leaf, "best", bootstrap=True, weights="balanced_subsample", seed=seed)


def boosting(k: int, rounds: int = 120, step: float = 0.08, depth: int = 5, balanced: bool = True,
             seed: int = 42, leaves: int = 31):
    """Two classes: boosted regression trees of ``depth``, as MLlib has them; more: one softmax model of best-first trees with ``leaves``."""
    weight = "weight" if balanced else None
    if k > 2:
        return SoftmaxBooster(k, rounds, step, leaves, weight=weight)
    return Trees(SoftmaxBooster(2, rounds, step, 1 << depth, 1, 0.0, 32, weight=weight, depth=depth, loss="residual"))


def mlp(n_features: int, k: int, hidden: tuple[int, ...] = (128, 64), seed: int = 42, max_iter: int = 100):
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                          layers=[n_features, *hidden, k], seed=seed, maxIter=max_iter)


def weighted_mlp(k: int, hidden: tuple[int, ...] = (128, 64), seed: int = 42, max_iter: int = 100) -> WeightedNet:
    """MLlib's net has no weights: this one multiplies each row's loss by its class weight."""
    return WeightedNet(k, hidden, max_iter, weight="weight", seed=seed)


class Dummy:
    """Most-frequent (ties → smallest class) or stratified (hash-uniform vs cumulative priors)."""

    def __init__(self, strategy: str = "most_frequent", seed: int = 42, key: str = "id"):
        if strategy not in ("most_frequent", "stratified"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.strategy, self.seed, self.key = strategy, seed, key

    def fit(self, train: DataFrame) -> "Dummy":
        counts = train.groupBy("label").count().orderBy(F.col("count").desc(), "label").collect()
        self.mode = float(counts[0]["label"])
        n = sum(r["count"] for r in counts)
        cum, self.cuts = 0.0, []
        for r in sorted(counts, key=lambda r: r["label"]):
            cum += r["count"] / n
            self.cuts.append((cum, float(r["label"])))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.strategy == "most_frequent":
            return df.withColumn("prediction", F.lit(self.mode))
        u = row_hash(F.col(self.key), self.seed % 7) / F.lit(2147483647.0)
        e = None
        for cut, lab in self.cuts:
            e = F.when(u < cut, F.lit(lab)) if e is None else e.when(u < cut, F.lit(lab))
        return df.withColumn("prediction", e.otherwise(F.lit(self.cuts[-1][1])))


def fit_predict(est, train: DataFrame, test: DataFrame) -> tuple[DataFrame, float]:
    """Fit, time the fit, and predict; adds ``score`` (P(class 1)) when probabilities exist."""
    t0 = time.perf_counter()
    model = est.fit(train)
    secs = time.perf_counter() - t0
    pred = model.transform(test)
    if "probability" in pred.columns:
        pred = pred.withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return pred, secs


def evaluate_row(pred: DataFrame, classes: list[str], **tags) -> DataFrame:
    """One metric row (accuracy, macro/weighted F1, balanced accuracy, MCC) + tags."""
    m = E.metric_bundle(pred.select(F.col("label").cast("int").alias("y"),
                                    F.col("prediction").cast("int").alias("p")), classes, "y", "p")
    return m.select(*[F.lit(v).alias(k) for k, v in tags.items()], "*")


def zoo(data: Data, specs: list[tuple[str, str, object]]) -> DataFrame:
    """Model-zoo benchmark: one metric row per (method, variant) estimator."""
    train, test = data.train, data.test
    rows = None
    for method, variant, est in specs:
        pred, secs = fit_predict(est, train, test)
        r = evaluate_row(pred, data.classes, method=method, variant=variant).withColumn(
            "train_seconds", F.lit(secs))
        rows = r if rows is None else rows.unionByName(r)
    return rows


class MacroF1Evaluator(Evaluator):
    """Macro-F1 over the classes present (CrossValidator has no built-in macro-F1)."""

    def __init__(self, k: int):
        super().__init__()
        self.k = k

    def _evaluate(self, dataset):
        classes = [str(i) for i in range(self.k)]
        m = E.metric_bundle(dataset.select(F.col("label").cast("int").alias("y"),
                                           F.col("prediction").cast("int").alias("p")), classes, "y", "p")
        return float(m.first()["macro_f1"])

    def isLargerBetter(self):
        return True


def grid_search(data: Data, est, grid: dict, folds: int = 3, seed: int = 42, parallelism: int = 2):
    """k-fold search with stratified fold ids (exact per class), scored by macro-F1.

    Ranking moves whole feature rows: it is done once, and every fold, side and fit reads the stored folds.
    """
    tr = store(stratified_folds(data.train, "label", data.key, folds, seed, out="fold"))
    b = ParamGridBuilder()
    for p, vals in grid.items():
        b = b.addGrid(getattr(est, p), vals)
    cv = CrossValidator(estimator=est, estimatorParamMaps=b.build(),
                        evaluator=MacroF1Evaluator(len(data.classes)), foldCol="fold",
                        parallelism=parallelism, seed=seed)
    try:
        return cv.fit(tr)
    finally:
        drop(tr)


def holdout_search(data: Data, make, params: list[dict], rare: list[str] | None = None,
                   fraction: float = 0.2, seed: int = 1) -> DataFrame:
    """Hold-out search on a stratified validation split; one row per candidate
    (position, params, macro_f1[, rare_recall]) — pick with ``best_candidate``."""
    sp = stratified_split(data.train, "label", data.key, fraction, seed)
    fit_on, val = sp.where(F.col("role") == "train"), sp.where(F.col("role") == "validation")
    rows = None
    for i, p in enumerate(params):
        pred, _ = fit_predict(make(fit_on, **p), fit_on, val)
        pm = pred.select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
        mr = E.metric_row(pm, data.classes, "y", "p")
        cols = [F.lit(i).alias("position"), F.lit(str(p)).alias("params"), F.col("macro_f1")]
        if rare:
            rr = sum((F.col(f"`recall:{c}`") for c in rare), F.lit(0.0)) / F.lit(float(len(rare)))
            cols.append(rr.alias("rare_recall"))
        r = mr.select(*cols)
        rows = r if rows is None else rows.unionByName(r)
    return rows


def tune_threshold_then_test(data: Data, make, betas: tuple[float, ...] = (2.0,), seed: int = 1) -> DataFrame:
    """Tune the decision threshold on a validation split (once per beta), refit on all train
    rows, score the test rows once: at the default 0.5 and at each tuned threshold."""
    sp = stratified_split(data.train, "label", data.key, 0.2, seed)
    fit_on, val = sp.where(F.col("role") == "train"), sp.where(F.col("role") == "validation")
    vpred, _ = fit_predict(make(fit_on), fit_on, val)
    policies = [("default", 0.5)]
    for beta in betas:
        sweep = E.threshold_sweep(vpred.select("score", F.col("label").cast("int").alias("y")), beta, score="score", y="y")
        policies.append((f"validation_F{beta:g}", float(E.best_candidate(sweep, "score").first()["threshold"])))
    tpred, _ = fit_predict(make(data.train), data.train, data.test)
    rows = None
    for name, thr in policies:
        p = tpred.select(F.col("label").cast("int").alias("y"), (F.col("score") >= thr).cast("int").alias("p"))
        r = E.binary_metrics(p, "y", "p").select(F.lit(name).alias("policy"), F.lit(thr).alias("threshold"),
                                                  "macro_f1", "normal_recall", "attack_recall", "fp_per_10k_benign")
        rows = r if rows is None else rows.unionByName(r)
    return rows


def l1_select(train: DataFrame, c: float = 0.05, tol: float = 1e-8) -> list[int]:
    """Feature indices with |w| > tol in an L1 logistic fit (none → all)."""
    m = logistic(train, c, balanced="weight" in train.columns, l1_ratio=1.0).fit(train)
    coef = m.coefficientMatrix.toArray()
    keep = [j for j in range(coef.shape[1]) if (abs(coef[:, j]) > tol).any()]
    return keep or list(range(coef.shape[1]))


def slice_features(df: DataFrame, idx: list[int]) -> DataFrame:
    vs = VectorSlicer(inputCol="features", outputCol="_f", indices=idx)
    return vs.transform(df).drop("features").withColumnRenamed("_f", "features")


def pca_fit(train: DataFrame, k: int):
    """PCA on (already z-scored) features; returns the model and explained variance."""
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(train)
    return model, list(model.explainedVariance.toArray())


def self_training(data: Data, make, labelled: DataFrame, threshold: float = 0.8,
                  max_rounds: int = 10) -> tuple[DataFrame, int]:
    """Self-training: fit on labelled rows, promote unlabelled rows whose top class
    probability ≥ threshold, refit; stop when nothing is promoted or after
    ``max_rounds``.  Each round's labelled set is cut with a reliable checkpoint,
    and its class weights are counted over that set alone."""
    key = data.key
    lab = labelled.select(key, "features", "label")
    pool = data.train.join(lab.select(key), key, "left_anti").select(key, "features")
    rounds = 0

    def refit(rows: DataFrame):
        rows = with_weights(rows)
        return make(rows).fit(rows)

    model = refit(lab)
    while rounds < max_rounds:
        scored = model.transform(pool).withColumn("_pmax", F.array_max(vector_to_array("probability")))
        new = scored.where(F.col("_pmax") >= threshold).select(key, "features", F.col("prediction").alias("label"))
        new = cut_lineage(new)
        if new.limit(1).count() == 0:
            break
        lab = cut_lineage(lab.unionByName(new))
        pool = cut_lineage(pool.join(new.select(key), key, "left_anti"))
        rounds += 1
        model = refit(lab)
    pred = model.transform(data.test)
    return pred, rounds


def seed_stability(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean ± population std of metrics over seeds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *aggs)


def group_ablation(data: Data, groups: dict[str, list[int]], make) -> DataFrame:
    """Balanced-LR macro-F1 per feature group (non-empty groups only)."""
    rows = None
    for name, idx in groups.items():
        if not idx:
            continue
        tr, te = slice_features(data.train, idx), slice_features(data.test, idx)
        pred, _ = fit_predict(make(tr), tr, te)
        r = evaluate_row(pred, data.classes, group=name, features=str(len(idx)))
        rows = r if rows is None else rows.unionByName(r)
    return rows


def importances(lr_model, rf_model, names: list[str]) -> list[tuple[str, float, float]]:
    """(feature, |LR coefficient| summed over classes, RF importance)."""
    coef = abs(lr_model.coefficientMatrix.toArray()).sum(axis=0)
    rf = rf_model.importances
    return [(n, float(coef[i]), float(rf[i])) for i, n in enumerate(names)]


def as_vector(df: DataFrame, arr: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(arr).cast("array<double>")))

