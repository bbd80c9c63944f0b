"""Registered model queries.

Learning runs on ``embeddings`` (10 labels; binary view: label 0 = normal,
anything else = attack) with a stratified 20 % test split by label; the
threshold policy and binned mutual information have DuckDB oracles, the
rest are rows-checked and covered by invariant tests.
"""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowlab.operators import anomaly as AN
from flowlab.operators import evaluate as E
from flowlab.operators import models as M
from flowlab.operators import prep as P
from flowlab.operators.neighbours import lof_scores
from flowlab.operators.label import FAMILY_ORDER, GROUP_ORDER, add_label_columns, feature_group_members
from flowlab.operators.sample import label_budget, stratified_split
from flowlab.plans import finish, query, rounded
from flowlab.plans.sql import FLOWS, NUMERIC, SCORED, with_
from flowlab.session import cut_lineage, spread
from flowlab.sources.files import NSL_CATEGORICAL, NSL_FEATURES
from flowlab.sources.tables import FLOW_NUMERIC, embeddings, flows, nsl_rows, scored

CLASSES10 = [str(i) for i in range(10)]
BIN = ["normal", "attack"]


def embed_data(spark, sf, binary: bool = False) -> M.Data:
    e = embeddings(spark, sf)
    sp = stratified_split(spread(e), "label", "vec_id", 0.2, 0, out="split", a="train", b="test")
    lab = (F.col("label") != 0).cast("double") if binary else F.col("label").cast("double")
    df = sp.select(F.col("vec_id").alias("id"), array_to_vector("embedding").alias("features"),
                   lab.alias("label"), "split")
    # every model reads this table many times: materialise it once (reliable
    # checkpoint in the shared folder), which also keeps the later plans short
    df = cut_lineage(M.with_weights(df, fitted=df.where(F.col("split") == "train")))
    return M.Data(df, BIN if binary else CLASSES10, "id")


def nsl_data(spark, sf, binary: bool = False) -> M.Data:
    """The 43-column rows, encoded by statistics of the train rows: binary, or the five families."""
    rows = spread(add_label_columns(nsl_rows(spark, sf), check=False))
    rows = stratified_split(rows, "attack_family", "event_id", 0.2, 0, out="split", a="train", b="test")
    numeric = [c for c in NSL_FEATURES if c not in NSL_CATEGORICAL]
    fp = P.fit(rows.where(F.col("split") == "train"), NSL_CATEGORICAL, numeric)
    code = F.col("binary_label") if binary else F.array_position(F.array(*[F.lit(f) for f in FAMILY_ORDER]), F.col("attack_family")) - 1
    df = fp.apply_vector(rows.withColumn("label", code.cast("double")).withColumnRenamed("event_id", "id"), keep=["id", "label", "split"])
    df = cut_lineage(M.with_weights(df, fitted=df.where(F.col("split") == "train")))
    data = M.Data(df, BIN if binary else FAMILY_ORDER, "id")
    data.names = fp.feature_names()
    return data


def _levels(spark, sf):
    """Both label levels, each with its name."""
    return ("binary", nsl_data(spark, sf, True)), ("family", nsl_data(spark, sf))


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rows(df):
    return finish(df)


_SPLIT_SQL = """r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY ((vec_id % 2147483647) * 48271) % 2147483647, vec_id) AS rk,
  count(*) OVER (PARTITION BY label) AS nc FROM embeddings),
sp AS (SELECT vec_id, label, CASE WHEN rk <= round_even(nc * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM r)"""


@query("m01_dummy_most_frequent", rounded(f"""WITH {_SPLIT_SQL},
mode AS (SELECT label FROM sp WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
t AS (SELECT count(*) AS n, sum((label = (SELECT label FROM mode))::INT) AS hit FROM sp WHERE split = 'test')
SELECT hit / n AS accuracy, 2.0 * hit / (hit + n) / 10 AS macro_f1 FROM t""", "accuracy", "macro_f1"))
def m01_dummy_most_frequent(spark, sf):
    d = embed_data(spark, sf)
    pred = M.Dummy("most_frequent").fit(d.train).transform(d.test)
    return finish(M.evaluate_row(pred, d.classes).select("accuracy", "macro_f1"))


@query("m01_dummy_stratified")
def m01_dummy_stratified(spark, sf):
    d = embed_data(spark, sf)
    pred = M.Dummy("stratified", key="id").fit(d.train).transform(d.test)
    return finish(M.evaluate_row(pred, d.classes, method="DummyClassifier", variant="stratified"))


@query("m02_logistic_variants")
def m02_logistic_variants(spark, sf):
    d = embed_data(spark, sf, binary=True)
    tr = d.train
    specs = [("LogReg", "l2_C1_unweighted", M.logistic(tr, 1.0, False)),
             ("LogReg", "l2_C1_balanced", M.logistic(tr, 1.0, True)),
             ("LogReg", "l2_C0.1_balanced", M.logistic(tr, 0.1, True)),
             ("LogReg", "l1_C0.1_balanced", M.logistic(tr, 0.1, True, l1_ratio=1.0)),
             ("LogReg", "elasticnet_balanced", M.logistic(tr, 0.1, True, l1_ratio=0.5))]
    return _rows(M.zoo(d, specs))


@query("m03_decision_tree")
def m03_decision_tree(spark, sf):
    d = embed_data(spark, sf)
    return _rows(M.zoo(d, [("DecisionTree", "balanced_depth18", M.decision_tree(True, 18, 3))]))


@query("m04_random_forest")
def m04_random_forest(spark, sf):
    d = embed_data(spark, sf)
    return _rows(M.zoo(d, [("RandomForest", "balanced_120", M.random_forest(120, 18, 3, True)),
                           ("RandomForest", "balanced_subsample_120", M.subsample_forest(10, 120, 18, 3))]))


@query("m05_extra_trees")
def m05_extra_trees(spark, sf):
    d = embed_data(spark, sf)
    return _rows(M.zoo(d, [("ExtraTrees", "balanced_120", M.extra_trees(10, 120, 18, 3))]))


@query("m06_boosting")
def m06_boosting(spark, sf):
    d = embed_data(spark, sf, binary=True)
    two = M.zoo(d, [("GBT", "balanced_120", M.boosting(2, 120, 0.08, 5, True))]).withColumn("level", F.lit("binary"))
    d = nsl_data(spark, sf)
    return _rows(two.unionByName(M.zoo(d, [("SoftmaxBoosting", "balanced_120", M.boosting(5, 120, 0.08))]).withColumn("level", F.lit("family"))))


@query("m07_mlp")
def m07_mlp(spark, sf):
    d = embed_data(spark, sf)
    n = len(d.df.select("features").first()[0])
    plain = M.mlp(n, 10, (128, 64))
    pred, _ = M.fit_predict(plain, d.train, d.test)
    a = M.evaluate_row(pred, d.classes, method="MLP", variant="unweighted")
    pred_w, _ = M.fit_predict(M.weighted_mlp(10, (128, 64)), d.train, d.test)
    b = M.evaluate_row(pred_w, d.classes, method="MLP", variant="weighted")
    return _rows(a.unionByName(b))


def _normal_split(spark, sf):
    d = embed_data(spark, sf, binary=True)
    normal = d.train.where(F.col("label") == 0)
    return d, normal


def _policy(d, scored_df, normal_scored):
    fam = scored_df.withColumn("attack_family", F.when(F.col("label") == 0, "normal").otherwise("attack"))
    return AN.threshold_policy(normal_scored, fam.withColumn("y", F.col("label").cast("int")),
                               [0.90, 0.95, 0.99], ["normal", "attack"], "score", "y", "attack_family")


@query("m09_kmeans_distance")
def m09_kmeans_distance(spark, sf):
    d, normal = _normal_split(spark, sf)
    sc = cut_lineage(AN.kmeans_distance(normal, d.df, 16, 42))
    return _rows(_policy(d, sc.where(F.col("split") == "test"),
                         sc.where((F.col("split") == "train") & (F.col("label") == 0))))


@query("m10_isolation_forest")
def m10_isolation_forest(spark, sf):
    d, normal = _normal_split(spark, sf)
    sc = cut_lineage(AN.isolation_forest(normal, d.df, "id", 150, 10_000, 42))  # scored once, read by every quantile
    return _rows(_policy(d, sc.where(F.col("split") == "test"),
                         sc.where((F.col("split") == "train") & (F.col("label") == 0))))


@query("m11_lof_policy")
def m11_lof_policy(spark, sf):
    """The normal-only threshold policy with local outlier factors as scores."""
    d, normal = _normal_split(spark, sf)
    arrays = lambda df: df.select("id", vector_to_array("features").alias("v"))
    lof = cut_lineage(lof_scores(arrays(normal), arrays(d.df), 35, "id", "id", "v"))
    sc = d.df.join(lof.select(F.col("query_id").alias("id"), F.col("lof").alias("score")), "id")
    return _rows(_policy(d, sc.where(F.col("split") == "test"), sc.where((F.col("split") == "train") & (F.col("label") == 0))))


@query("m12_reconstruction_error")
def m12_reconstruction_error(spark, sf):
    d, _ = _normal_split(spark, sf)
    centre = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_c").fit(
        d.train.where(F.col("label") == 0))
    x = centre.transform(d.df).drop("features").withColumnRenamed("_c", "features")
    tr = x.where(F.col("split") == "train")
    sp = stratified_split(tr, "label", "id", 0.2, 3, out="role", a="fit", b="validation")
    fit_normal = sp.where((F.col("role") == "fit") & (F.col("label") == 0))
    val_normal = sp.where((F.col("role") == "validation") & (F.col("label") == 0))
    both = val_normal.select("id", "features", "label", F.lit("validation").alias("part")).unionByName(
        x.where(F.col("split") == "test").select("id", "features", "label", F.lit("test").alias("part")))
    errors = cut_lineage(AN.reconstruction_error(fit_normal, both, 8))
    t = AN.normal_quantile_threshold(errors.where(F.col("part") == "validation"), 0.95)
    te = errors.where(F.col("part") == "test")
    pred = te.withColumn("prediction", (F.col("score") >= F.lit(t)).cast("double"))
    return _rows(M.evaluate_row(pred, BIN, method="PCA_reconstruction", variant="k8_q0.95")
                 .withColumn("threshold", F.lit(t)))


_M13_SQL = with_(SCORED, "t AS (" + "\nUNION ALL\n".join(
    f"SELECT {q}::DOUBLE AS normal_quantile, quantile_cont(score, {q}) AS threshold FROM scored WHERE split = 'train' AND y = 0"
    for q in (0.90, 0.95, 0.99)) + ")",
                 """p AS (SELECT t.normal_quantile, t.threshold, s.y, s.attack_family, (s.score >= t.threshold)::INT AS yhat
  FROM t, scored s WHERE s.split = 'test')""",
                 """c AS (SELECT normal_quantile, threshold,
  sum(CASE WHEN y = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS tp,
  """ + ", ".join(
                     f"avg(CASE WHEN attack_family = '{f}' THEN (CASE WHEN '{f}' = 'normal' THEN (yhat = 0)::INT ELSE (yhat = 1)::INT END) END) AS \"family_{f}_recall\""
                     for f in FAMILY_ORDER) + """ FROM p GROUP BY normal_quantile, threshold)""") + """
SELECT normal_quantile, threshold, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
  (2 * tp / greatest(2 * tp + fp + fn, 1) + 2 * tn / greatest(2 * tn + fp + fn, 1)) / 2 AS macro_f1,
  CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS normal_recall,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS attack_recall, """ + ", ".join(
    f"coalesce(\"family_{f}_recall\", 0.0) AS \"family_{f}_recall\"" for f in FAMILY_ORDER) + " FROM c"


@query("m13_threshold_policy", rounded(_M13_SQL, "normal_quantile", "threshold", "accuracy", "macro_f1",
                                       "normal_recall", "attack_recall", *[f'"family_{f}_recall"' for f in FAMILY_ORDER]))
def m13_threshold_policy(spark, sf):
    s = scored(spark, sf)
    normal = s.where((F.col("split") == "train") & (F.col("y") == 0))
    return finish(AN.threshold_policy(normal, s.where(F.col("split") == "test"), [0.90, 0.95, 0.99],
                                      FAMILY_ORDER, "score", "y", "attack_family"))


@query("m14_pca_variance")
def m14_pca_variance(spark, sf):
    d = embed_data(spark, sf)
    centre = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_c").fit(d.train)
    tr = centre.transform(d.train).drop("features").withColumnRenamed("_c", "features")
    _, ev = M.pca_fit(tr, 10)
    cum, rows = 0.0, []
    for i, v in enumerate(ev):
        cum += v
        rows.append((i, float(v), float(cum)))
    return spark.createDataFrame(rows, "component int, explained_variance double, cumulative double")


@query("m15_l1_selection")
def m15_l1_selection(spark, sf):
    d = embed_data(spark, sf, binary=True)
    idx = M.l1_select(d.train, 0.05)
    tr, te = M.slice_features(d.train, idx), M.slice_features(d.test, idx)
    pred, _ = M.fit_predict(M.logistic(tr, 1.0, True), tr, te)
    return _rows(M.evaluate_row(pred, BIN, method="LogReg", variant="l1_selected")
                 .withColumn("selected_features", F.lit(len(idx))))


def binned_mi(df, features, target, bins: int = 10):
    """Mutual information (nats) between each equal-width-binned feature and the target."""
    from flowlab.operators.quality import unpivot_strings  # noqa: F401
    mm = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(features)],
                *[F.max(c).alias(f"hi{i}") for i, c in enumerate(features)]).first()
    cells = []
    for i, c in enumerate(features):
        lo, hi = mm[f"lo{i}"], mm[f"hi{i}"]
        width = (hi - lo) if hi is not None and hi > lo else None
        b = (F.lit(0) if width is None else
             F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1)).cast("int"))
        cells.append(F.struct(F.lit(c).alias("feature"), b.alias("bin")))
    long = df.select(F.col(target).alias("_t"), F.explode(F.array(*cells)).alias("s")).select("_t", "s.*")
    joint = long.groupBy("feature", "bin", "_t").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    n = F.sum("n").over(Window.partitionBy("feature"))
    pb = F.sum("n").over(Window.partitionBy("feature", "bin"))
    pt = F.sum("n").over(Window.partitionBy("feature", "_t"))
    j = joint.select("feature", "n", n.alias("_tot"), pb.alias("nb"), pt.alias("nt"))
    return j.groupBy("feature").agg(
        F.sum(F.col("n") / F.col("_tot") * F.log(F.col("n") * F.col("_tot") / (F.col("nb") * F.col("nt"))))
        .alias("mutual_information"))


@query("m16_mutual_information", rounded(with_(FLOWS, "mm AS (SELECT " + ", ".join(
    f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMERIC) + " FROM flows)", "l AS (" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, CASE WHEN (SELECT hi_{c} FROM mm) > (SELECT lo_{c} FROM mm)
  THEN least(floor(({c} - (SELECT lo_{c} FROM mm)) / ((SELECT hi_{c} FROM mm) - (SELECT lo_{c} FROM mm)) * 10), 9) ELSE 0 END AS bin,
  binary_label AS t FROM flows""" for c in NUMERIC) + ")",
    "j AS (SELECT feature, bin, t, count(*) AS n FROM l GROUP BY ALL)",
    """k AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, bin) AS nb,
  sum(n) OVER (PARTITION BY feature, t) AS nt FROM j)""") + """
SELECT feature, sum(n / nn * ln(n * nn / (nb * nt))) AS mutual_information FROM k GROUP BY feature""",
    "mutual_information"))
def m16_mutual_information(spark, sf):
    return finish(binned_mi(flows(spark, sf), FLOW_NUMERIC, "binary_label"))


def _dims(d: M.Data):
    n = len(d.df.select("features").first()[0])
    return n, [f"dim_{i}" for i in range(n)]


@query("m17_importance_consensus")
def m17_importance_consensus(spark, sf):
    d = embed_data(spark, sf, binary=True)
    n, names = _dims(d)
    lr = M.logistic(d.train, 1.0, True).fit(d.train)
    rf = M.random_forest(80, 12, 3, True).fit(d.train)
    imp = M.importances(lr, rf, names)
    arr = d.train.select(vector_to_array("features").alias("a"), F.col("label").alias("y"))
    wide = arr.select("y", *[F.col("a")[i].alias(nm) for i, nm in enumerate(names)])
    mi = {r["feature"]: r["mutual_information"] for r in binned_mi(wide, names, "y").collect()}
    rows = [(nm, c, r, float(mi.get(nm, 0.0))) for nm, c, r in imp]
    t = spark.createDataFrame(rows, "feature string, lr_abs_coef double, rf_importance double, mi double")
    from flowlab.operators.prep import max_normalise
    for c in ("lr_abs_coef", "rf_importance", "mi"):
        t = max_normalise(t, c)
    t = t.withColumn("importance_consensus",
                     (F.col("lr_abs_coef_norm") + F.col("rf_importance_norm") + F.col("mi_norm")) / 3)
    return _rows(t.orderBy(F.col("importance_consensus").desc(), "feature"))


@query("m19_threshold_tuning")
def m19_threshold_tuning(spark, sf):
    """Default, F1 and F2 policies of several models, each tuned on validation rows and tested once."""
    d = nsl_data(spark, sf, binary=True)
    models = {"LogReg": lambda tr: M.logistic(tr, 1.0, True), "DecisionTree": lambda tr: M.decision_tree(True, 8, 3),
              "RandomForest": lambda tr: M.random_forest(30, 8, 3, True)}
    return _rows(_union([M.tune_threshold_then_test(d, make, (1.0, 2.0)).withColumn("model", F.lit(name)) for name, make in models.items()]))


@query("m20_grid_search")
def m20_grid_search(spark, sf):
    d = nsl_data(spark, sf, binary=True)
    out = []
    for name, est, grid in (("RandomForest", M.random_forest(40, 10, 3, True), {"maxDepth": [5, 10], "numTrees": [20, 40]}),
                            ("GBT", M.boosting(2, 10, 0.1, 3, True), {"maxDepth": [2, 4]})):
        cv = M.grid_search(d, est, grid, folds=3)
        best = cv.bestModel
        out.append(M.evaluate_row(best.transform(d.test), d.classes, method=name, variant="cv3_macro_f1")
                   .withColumn("cv_best_macro_f1", F.lit(float(max(cv.avgMetrics)))).withColumn("candidates", F.lit(len(cv.avgMetrics)))
                   .withColumn("best_depth", F.lit(best.getMaxDepth())).withColumn("best_trees", F.lit(best.getNumTrees)))
    return _rows(_union(out))


@query("m21_holdout_search")
def m21_holdout_search(spark, sf):
    """Logistic and forest candidates by macro-F1, with the recall of the rare families."""
    d = nsl_data(spark, sf)

    def make(tr, model, **p):
        return M.logistic(tr, p["c"], True) if model == "LogReg" else M.random_forest(p["trees"], p["depth"], 3, True)

    params = [{"model": "LogReg", "c": c} for c in (0.1, 1.0, 10.0)] + [{"model": "RandomForest", "trees": 20, "depth": n} for n in (4, 10)]
    rows = M.holdout_search(d, make, params, rare=["R2L", "U2R"])
    best = E.best_candidate(rows, "macro_f1")
    return _rows(rows.join(best.select("position").withColumn("is_best", F.lit(True)), "position", "left")
                 .na.fill(False, ["is_best"]))


@query("m22_model_zoo")
def m22_model_zoo(spark, sf):
    """Dummy, logistic, tree, forest, extra trees and boosting at both label levels."""
    out = []
    for level, d in _levels(spark, sf):
        tr = d.train
        dummy = M.evaluate_row(M.Dummy("most_frequent").fit(tr).transform(d.test), d.classes, method="DummyClassifier", variant="most_frequent")
        specs = [("LogReg", "l2_C1_balanced", M.logistic(tr, 1.0, True)), ("DecisionTree", "balanced_depth18", M.decision_tree(True)),
                 ("RandomForest", "balanced_30", M.random_forest(30, 12, 3, True)), ("ExtraTrees", "balanced_30", M.extra_trees(len(d.classes), 30, 12, 3)),
                 ("GBT", "balanced_10", M.boosting(len(d.classes), 10, 0.2, 4, True))]
        out += [x.withColumn("level", F.lit(level)) for x in (dummy.withColumn("train_seconds", F.lit(0.0)), M.zoo(d, specs))]
    return _rows(_union(out))


@query("m23_group_ablation")
def m23_group_ablation(spark, sf):
    """Balanced logistic models on the eight named feature groups."""
    d = nsl_data(spark, sf, binary=True)
    names = spark.createDataFrame(list(enumerate(d.names)), "position int, name string")
    members = {}
    for r in feature_group_members(names, categorical=NSL_CATEGORICAL).orderBy("position").collect():  # a row per feature and group
        members.setdefault(r.group, []).append(r.position)
    return _rows(M.group_ablation(d, {g: members.get(g, []) for g in GROUP_ORDER}, lambda tr: M.logistic(tr, 1.0, True)))


@query("m24_representations")
def m24_representations(spark, sf):
    d = embed_data(spark, sf, binary=True)
    n, names = _dims(d)
    make = lambda tr: M.logistic(tr, 1.0, True)
    out = M.group_ablation(d, {"raw": list(range(n))}, make)
    arr = d.train.select(vector_to_array("features").alias("a"), F.col("label").alias("y"))
    wide = arr.select("y", *[F.col("a")[i].alias(nm) for i, nm in enumerate(names)])
    mi = binned_mi(wide, names, "y").orderBy(F.col("mutual_information").desc(), "feature").limit(30).collect()
    top = sorted(names.index(r["feature"]) for r in mi)
    out = out.unionByName(M.group_ablation(d, {"mi_top30": top}, make))
    out = out.unionByName(M.group_ablation(d, {"l1_selected": M.l1_select(d.train, 0.05)}, make))
    pca, _ = M.pca_fit(d.train, min(30, n))
    pd_ = M.Data(pca.transform(d.df).drop("features").withColumnRenamed("pca", "features"), d.classes, "id")
    out = out.unionByName(M.group_ablation(pd_, {"pca30": list(range(min(30, n)))}, make))
    return _rows(out)


@query("m25_self_training")
def m25_self_training(spark, sf):
    d = embed_data(spark, sf, binary=True)
    make = lambda tr: M.logistic(tr, 1.0, True)
    rows = []
    for budget in (0.01, 0.05, 0.1, 0.25):
        lab = M.with_weights(label_budget(d.train, "label", "id", budget))
        pred, _ = M.fit_predict(make(lab), lab, d.test)
        r1 = M.evaluate_row(pred, BIN, method="labelled_only_logreg", variant=str(budget))
        pred2, rounds = M.self_training(d, make, lab, 0.8, 10)
        r2 = M.evaluate_row(pred2, BIN, method="self_training_logreg", variant=str(budget)) \
            .withColumn("rounds", F.lit(rounds))
        rows += [r1.withColumn("rounds", F.lit(0)), r2]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return _rows(out)


@query("m26_seed_stability")
def m26_seed_stability(spark, sf):
    """Four models, two label levels, five seeds."""
    runs = []
    for level, d in _levels(spark, sf):
        n = len(d.names)
        for seed in range(5):
            for name, est in (("RandomForest", M.random_forest(10, 8, 3, True, seed=seed)), ("ExtraTrees", M.extra_trees(len(d.classes), 10, 8, 3, seed=seed)),
                              ("DecisionTree", M.decision_tree(True, 8, 3, seed=seed)), ("MLP", M.mlp(n, len(d.classes), (16,), seed=seed, max_iter=20))):
                pred, _ = M.fit_predict(est, d.train, d.test)
                runs.append(M.evaluate_row(pred, d.classes, model=name, scheme=level, seed=seed).select("model", "scheme", "seed", "macro_f1", "accuracy").first())
    rows = spark.createDataFrame(runs, "model string, scheme string, seed int, macro_f1 double, accuracy double")  # a row per run
    return _rows(M.seed_stability(rows, ["model", "scheme"], ["macro_f1", "accuracy"]))


@query("m27_weighted_contrast")
def m27_weighted_contrast(spark, sf):
    d = nsl_data(spark, sf, binary=True)
    tr = d.train
    specs = [(name, variant, make(balanced)) for name, make in (
        ("LogReg", lambda b: M.logistic(tr, 1.0, b)), ("RandomForest", lambda b: M.random_forest(30, 10, 3, b)),
        ("GBT", lambda b: M.boosting(2, 10, 0.2, 4, b))) for variant, balanced in (("unweighted", False), ("balanced", True))]
    n = len(d.names)
    specs += [("MLP", "unweighted", M.mlp(n, 2, (128, 64))), ("MLP", "balanced", M.weighted_mlp(2, (128, 64)))]
    return _rows(M.zoo(d, specs))


@query("m28_multi_test")
def m28_multi_test(spark, sf):
    d = embed_data(spark, sf)
    model = M.random_forest(80, 12, 3, True).fit(d.train)
    full = model.transform(d.test)
    hard = model.transform(d.test.where(F.col("label") >= 5))  # second test set: the upper half of the classes
    return _rows(M.evaluate_row(full, d.classes, test_set="test").unionByName(
        M.evaluate_row(hard, d.classes, test_set="test_upper_classes")))


@query("a32_mean_std_over_seeds", rounded(with_(SCORED, "s AS (SELECT unnest(range(5)) AS seed)",
                                                """r AS (SELECT s.seed, avg(((sc.score >= (30 + 5 * s.seed)::DOUBLE / 100.0::DOUBLE)::INT = sc.y)::INT::DOUBLE) AS accuracy
  FROM s, scored sc GROUP BY s.seed)""") + """
SELECT 'threshold_rule' AS model, 'binary' AS scheme, count(*) AS runs, avg(accuracy) AS accuracy_mean,
  stddev_pop(accuracy) AS accuracy_std FROM r""", "accuracy_mean", "accuracy_std"))
def a32_mean_std_over_seeds(spark, sf):
    s = scored(spark, sf)
    runs = None
    for seed in range(5):
        t = (30 + 5 * seed) / 100.0
        r = s.agg(F.avg(((F.col("score") >= F.lit(t)).cast("int") == F.col("y")).cast("double")).alias("accuracy")) \
            .select(F.lit("threshold_rule").alias("model"), F.lit("binary").alias("scheme"), F.lit(seed).alias("seed"),
                    "accuracy")
        runs = r if runs is None else runs.unionByName(r)
    return finish(M.seed_stability(runs, ["model", "scheme"], ["accuracy"]))
