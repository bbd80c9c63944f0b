"""Model-agnostic evaluation over a predictions DataFrame.

Every metric starts from one aggregation of the (possibly huge) prediction
table into at most K×K confusion cells, or into one row per distinct score;
everything after that runs on those small tables.  Class codes are
integers ``0..K-1``; ``classes`` gives their names.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.operators.ordered import attach_totals, running_totals


def _div(a, b):
    """a / b with 0 when b == 0 (sklearn ``zero_division=0``)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def class_dim(spark: SparkSession, classes: list[str], code: str = "class_index",
              name: str = "class_name") -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(classes)],
                                 f"{code} int, {name} string")


def cell_counts(pred: DataFrame, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """(y_true, y_pred, n): the only pass over the prediction rows (map-side combined)."""
    return (pred.groupBy(F.col(y).cast("int").alias("y_true"),
                         F.col(yhat).cast("int").alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion(pred: DataFrame, classes: list[str], y: str = "y_true",
              yhat: str = "y_pred") -> DataFrame:
    """Confusion matrix over the full K×K grid: raw count ``n`` and row share ``rate``.

    Absent cells are 0; the row denominator is at least 1.
    """
    spark = pred.sparkSession
    k = len(classes)
    grid = (spark.range(k).select(F.col("id").cast("int").alias("y_true"))
            .select("y_true", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("y_pred")))
    cells = grid.join(cell_counts(pred, y, yhat), ["y_true", "y_pred"], "left")
    cells = cells.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    row_total = F.sum("n").over(Window.partitionBy("y_true"))
    names = F.array(*[F.lit(c) for c in classes])
    return cells.select(
        "y_true", "y_pred",
        F.element_at(names, F.col("y_true") + 1).alias("true_class"),
        F.element_at(names, F.col("y_pred") + 1).alias("pred_class"),
        "n", (F.col("n") / F.greatest(row_total, F.lit(1))).alias("rate"))


def class_stats(pred: DataFrame, classes: list[str], y: str = "y_true",
                yhat: str = "y_pred") -> DataFrame:
    """Per-class tp, support, predicted, precision, recall, f1 for every declared class."""
    cm = confusion(pred, classes, y, yhat)
    truth = cm.groupBy(F.col("y_true").alias("class_index")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cm.groupBy(F.col("y_pred").alias("class_index")).agg(
        F.sum("n").alias("predicted"))
    s = class_dim(pred.sparkSession, classes).join(truth, "class_index").join(
        predicted, "class_index")
    return s.select(
        "class_index", "class_name", F.col("tp").cast("long").alias("tp"),
        F.col("support").cast("long").alias("support"),
        F.col("predicted").cast("long").alias("predicted"),
        _div(F.col("tp"), F.col("predicted")).alias("precision"),
        _div(F.col("tp"), F.col("support")).alias("recall"),
        _div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def metric_bundle(pred: DataFrame, classes: list[str], y: str = "y_true", yhat: str = "y_pred",
                  present_only: bool = False) -> DataFrame:
    """One row: accuracy, macro precision/recall/F1, weighted F1, balanced accuracy, MCC.

    ``present_only=False`` averages over every declared class (absent ones
    count as 0); ``True`` averages only classes seen in truth or prediction.
    Balanced accuracy averages recall over classes with support, MCC is the
    K-class generalisation (0 when undefined).
    """
    s = class_stats(pred, classes, y, yhat)
    if present_only:
        s = s.where((F.col("support") > 0) | (F.col("predicted") > 0))
    n = F.sum("support")
    agg = s.agg(
        n.alias("_n"), F.sum("tp").alias("_c"), F.count(F.lit(1)).alias("_k"),
        F.sum("precision").alias("_sp"), F.sum("recall").alias("_sr"), F.sum("f1").alias("_sf"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf"),
        F.sum(F.when(F.col("support") > 0, F.col("recall"))).alias("_br"),
        F.sum(F.when(F.col("support") > 0, 1).otherwise(0)).alias("_bk"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("_tp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("_tt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("_pp"))
    nn = F.col("_n").cast("double")
    mcc_den = F.sqrt((nn * nn - F.col("_pp")) * (nn * nn - F.col("_tt")))
    return agg.select(
        _div(F.col("_c"), F.col("_n")).alias("accuracy"),
        _div(F.col("_sp"), F.col("_k")).alias("macro_precision"),
        _div(F.col("_sr"), F.col("_k")).alias("macro_recall"),
        _div(F.col("_sf"), F.col("_k")).alias("macro_f1"),
        _div(F.col("_wf"), F.col("_n")).alias("weighted_f1"),
        _div(F.col("_br"), F.col("_bk")).alias("balanced_accuracy"),
        _div(F.col("_c").cast("double") * nn - F.col("_tp"), mcc_den).alias("mcc"))


def metric_row(pred: DataFrame, classes: list[str], y: str = "y_true",
               yhat: str = "y_pred") -> DataFrame:
    """Flat tuning row: accuracy, present-label macro/weighted F1 plus
    ``recall:<c>``, ``f1:<c>``, ``support:<c>`` for every declared class."""
    s = class_stats(pred, classes, y, yhat)
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    cols = [_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
            _div(F.sum(F.when(present, F.col("f1"))), F.sum(F.when(present, 1).otherwise(0)))
            .alias("macro_f1"),
            _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")]
    for i, c in enumerate(classes):
        sel = F.col("class_index") == i
        cols += [F.max(F.when(sel, F.col("recall"))).alias(f"recall:{c}"),
                 F.max(F.when(sel, F.col("f1"))).alias(f"f1:{c}"),
                 F.max(F.when(sel, F.col("support"))).alias(f"support:{c}")]
    return s.agg(*cols)


def rare_recall_mean(row: DataFrame, rare_classes: list[str]) -> DataFrame:
    """Mean recall of the named rare classes from a ``metric_row``; empty list is an error."""
    if not rare_classes:
        raise ValueError("rare_classes must not be empty")
    missing = [c for c in rare_classes if f"recall:{c}" not in row.columns]
    if missing:
        raise ValueError(f"unknown rare classes: {sorted(missing)}")
    total = sum((F.col(f"`recall:{c}`") for c in rare_classes), F.lit(0.0))
    return row.select((total / F.lit(float(len(rare_classes)))).alias("rare_recall_mean"))


def score_table(pred: DataFrame, score: str = "score", y: str = "y_true",
                bins: int | None = None) -> DataFrame:
    """(score, p, n): positives/negatives per distinct score — one aggregation.

    ``bins`` (optional, approximate) floors scores in [0, 1] to a grid of that
    many cells first, bounding the table when nearly every score is distinct.
    """
    yy = F.col(y).cast("int")
    s = F.col(score).cast("double")
    if bins:
        s = F.floor(s * F.lit(bins)) / F.lit(float(bins))
    return pred.where(F.col(score).isNotNull()).groupBy(s.alias("score")).agg(
        F.sum(F.when(yy == 1, 1).otherwise(0)).cast("long").alias("p"),
        F.sum(F.when(yy == 1, 0).otherwise(1)).cast("long").alias("n"))


def binary_auc(pred: DataFrame, score: str = "score", y: str = "y_true",
               buckets: int | None = None, bins: int | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision (step, not trapezoid).

    With p, n the positives/negatives at one score and tp/fp the totals at
    or above it: AUC = Σ n/N·(tp − p/2)/P and AP = Σ p/P·tp/(tp+fp).
    """
    distinct = pred.select(F.col(y).cast("int").alias("_y")).distinct()
    bad = distinct.where(~F.col("_y").isin(0, 1)).limit(1).collect()
    if bad:
        raise ValueError("AUC needs a binary 0/1 truth column")
    st = running_totals(score_table(pred, score, y, bins), "score", ["p", "n"], True, buckets)
    tot = st.agg(F.sum("p").alias("_pos"), F.sum("n").alias("_neg"),
                 F.sum(F.col("n") * (F.col("cum_p") - F.col("p") / 2.0)).alias("_auc"),
                 F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("cum_p")
                              / (F.col("cum_p") + F.col("cum_n")))).alias("_ap"))
    return tot.select(
        F.when((F.col("_pos") == 0) | (F.col("_neg") == 0), F.lit(None).cast("double"))
        .otherwise(F.col("_auc") / (F.col("_pos").cast("double") * F.col("_neg"))).alias("roc_auc"),
        F.when(F.col("_pos") == 0, F.lit(None).cast("double"))
        .otherwise(F.coalesce(F.col("_ap"), F.lit(0.0)) / F.col("_pos")).alias("pr_auc"))


def curve_points(pred: DataFrame, score: str = "score", y: str = "y_true",
                 buckets: int | None = None, bins: int | None = None) -> DataFrame:
    """ROC / PR points at every distinct score threshold (score >= t is positive)
    with the prevalence baseline of the PR plot."""
    st = running_totals(score_table(pred, score, y, bins), "score", ["p", "n"], True, buckets)
    totals = st.agg(F.sum("p").alias("_pos"), F.sum("n").alias("_neg"))
    j = attach_totals(st, totals)
    return j.select(
        F.col("score").alias("threshold"),
        F.col("cum_p").alias("tp"), F.col("cum_n").alias("fp"),
        _div(F.col("cum_n"), F.col("_neg")).alias("fpr"),
        _div(F.col("cum_p"), F.col("_pos")).alias("tpr"),
        _div(F.col("cum_p"), F.col("cum_p") + F.col("cum_n")).alias("precision"),
        _div(F.col("_pos"), F.col("_pos") + F.col("_neg")).alias("prevalence"))


def binary_metrics(pred: DataFrame, y: str = "y_true", yhat: str = "y_pred",
                   by: list[str] | None = None) -> DataFrame:
    """The binary metric row: confusion cells, rates, per-10k figures, MCC, F1s.

    With ``by`` one row per group, all from a single aggregation.
    """
    by = by or []
    yy, pp = F.col(y).cast("int"), F.col(yhat).cast("int")
    c = pred.groupBy(*by).agg(
        F.sum(F.when((yy == 0) & (pp == 0), 1).otherwise(0)).cast("long").alias("true_negative"),
        F.sum(F.when((yy == 0) & (pp == 1), 1).otherwise(0)).cast("long").alias("false_positive"),
        F.sum(F.when((yy == 1) & (pp == 0), 1).otherwise(0)).cast("long").alias("false_negative"),
        F.sum(F.when((yy == 1) & (pp == 1), 1).otherwise(0)).cast("long").alias("true_positive"))
    tn, fp = F.col("true_negative"), F.col("false_positive")
    fn, tp = F.col("false_negative"), F.col("true_positive")
    n = tn + fp + fn + tp
    p_att, r_att = _div(tp, tp + fp), _div(tp, tp + fn)
    p_nor, r_nor = _div(tn, tn + fn), _div(tn, tn + fp)
    f_att, f_nor = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fp + fn)
    fpr = fp / F.greatest(fp + tn, F.lit(1))
    fnr = fn / F.greatest(fn + tp, F.lit(1))
    d = lambda x: x.cast("double")
    mcc_den = F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn))
    has_att = F.when(tp + fn > 0, 1).otherwise(0)
    has_nor = F.when(tn + fp > 0, 1).otherwise(0)
    return c.select(
        *by,
        _div(tp + tn, n).alias("accuracy"),
        _div(has_att * r_att + has_nor * r_nor, has_att + has_nor).alias("balanced_accuracy"),
        p_att.alias("precision_attack"),
        ((p_att + p_nor) / 2).alias("macro_precision"),
        ((f_att + f_nor) / 2).alias("macro_f1"),
        _div(f_att * (tp + fn) + f_nor * (tn + fp), n).alias("weighted_f1"),
        r_nor.alias("normal_recall"), r_att.alias("attack_recall"),
        _div(d(tp) * d(tn) - d(fp) * d(fn), mcc_den).alias("mcc"),
        tn, fp, fn, tp,
        fpr.alias("false_positive_rate"), fnr.alias("false_negative_rate"),
        (fpr * 10000).alias("fp_per_10k_benign"), (fnr * 10000).alias("fn_per_10k_attack"))


def fp_per_10k_benign(pred: DataFrame, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """False alerts per 10,000 benign rows; 0 when there is no benign row."""
    yy, pp = F.col(y).cast("int"), F.col(yhat).cast("int")
    c = pred.agg(F.sum(F.when(yy == 0, 1).otherwise(0)).alias("benign"),
                 F.sum(F.when((yy == 0) & (pp == 1), 1).otherwise(0)).alias("fp"))
    return c.select(_div(F.col("fp") * 10000, F.col("benign")).alias("fp_per_10k_benign"))


def family_recall(pred: DataFrame, families: list[str], family: str = "attack_family",
                  yhat: str = "y_pred", normal: str = "normal") -> DataFrame:
    """Detection recall per family: share predicted 1 (``normal``: predicted 0).

    Every listed family appears; an absent family gets 0.
    """
    hit = F.when(F.col(family) == normal, (F.col(yhat) == 0)).otherwise(F.col(yhat) == 1)
    rec = pred.groupBy(F.col(family).alias("family")).agg(
        F.avg(hit.cast("double")).alias("recall"), F.count(F.lit(1)).alias("rows"))
    dim = pred.sparkSession.createDataFrame([(i, f) for i, f in enumerate(families)],
                                            "family_order int, family string")
    return dim.join(rec, "family", "left").select(
        "family_order", "family", F.coalesce("recall", F.lit(0.0)).alias("recall"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def threshold_index(score: str, thresholds: list[float], out: str = "_ti"):
    """Bucketizer giving, per row, how many thresholds are <= score (exact double compare)."""
    splits = [float("-inf")] + sorted(thresholds) + [float("inf")]
    return Bucketizer(splits=splits, inputCol=score, outputCol=out, handleInvalid="keep")


def default_thresholds() -> list[float]:
    # i / 100 with an integer i, not linspace: the doubles must equal the oracle's
    return [i / 100.0 for i in range(5, 96)]


def threshold_sweep(pred: DataFrame, beta: float = 2.0, thresholds: list[float] | None = None,
                    score: str = "score", y: str = "y_true") -> DataFrame:
    """F-beta of ``score >= t`` for every threshold, in one pass over the rows.

    Rows are binned to the number of thresholds at or below their score; the
    per-threshold tp/fp are then suffix sums over at most len(thresholds)+1 bins.
    """
    ts = sorted(thresholds or default_thresholds())
    spark = pred.sparkSession
    yy = F.col(y).cast("int")
    binned = threshold_index("_s", ts).transform(
        pred.select(F.col(score).cast("double").alias("_s"), yy.alias("_y")).where(
            F.col("_s").isNotNull()))
    bins = binned.groupBy(F.col("_ti").cast("int").alias("bin")).agg(
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("long").alias("p"),
        F.sum(F.when(F.col("_y") == 1, 0).otherwise(1)).cast("long").alias("n"))
    tdf = spark.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "bin int, threshold double")
    # the bins table has at most len(thresholds)+1 rows: one-partition windows are fine
    P = F.sum("p").over(Window.partitionBy())
    Nn = F.sum("n").over(Window.partitionBy())
    allb = (spark.range(0, len(ts) + 1).select(F.col("id").cast("int").alias("bin"))
            .join(bins, "bin", "left").na.fill(0, ["p", "n"]))
    suffix = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = allb.select("bin", F.sum("p").over(suffix).alias("tp"), F.sum("n").over(suffix).alias("fp"),
                      P.alias("_pos"), Nn.alias("_neg"))
    b2 = float(beta) ** 2
    j = tdf.join(cum, "bin")
    prec = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    rec = F.col("tp") / F.greatest(F.col("_pos"), F.lit(1))
    return j.select(
        (F.col("bin") - 1).alias("position"), "threshold", "tp", "fp",
        (F.col("_pos") - F.col("tp")).alias("fn"), (F.col("_neg") - F.col("fp")).alias("tn"),
        prec.alias("precision"), rec.alias("recall"),
        ((1 + b2) * prec * rec / F.greatest(b2 * prec + rec, F.lit(1e-12))).alias("score"))


def best_candidate(rows: DataFrame, metric: str, maximize: bool = True,
                   position: str = "position") -> DataFrame:
    """Arg-best row; ties keep the earliest ``position``. Empty input is an error."""
    if not rows.limit(1).collect():
        raise ValueError("cannot select from an empty candidate list")
    order = F.col(metric).desc() if maximize else F.col(metric).asc()
    return rows.orderBy(order, F.col(position).asc()).limit(1)


def alert_workload(rates: DataFrame, daily_flows: int = 1_000_000,
                   malicious_rate: float = 0.005, normal_recall: str = "normal_recall",
                   attack_recall: str = "attack_recall") -> DataFrame:
    """Daily alert projection of (normal recall, attack recall) rows."""
    benign = float(daily_flows) * (1.0 - malicious_rate)
    malicious = float(daily_flows) * malicious_rate
    false_alerts = F.lit(benign) * (F.lit(1.0) - F.col(normal_recall))
    true_alerts = F.lit(malicious) * F.col(attack_recall)
    total = false_alerts + true_alerts
    return rates.select(
        "*", false_alerts.alias("false_alerts_per_day"), true_alerts.alias("true_alerts_per_day"),
        (F.lit(malicious) * (F.lit(1.0) - F.col(attack_recall))).alias("missed_attacks_per_day"),
        total.alias("total_alerts_per_day"),
        F.when(total == 0, F.lit(0.0)).otherwise(true_alerts / total).alias("operational_precision"))


def bootstrap_ci(pred: DataFrame, n_boot: int = 300, seed: int = 42, y: str = "y_true",
                 yhat: str = "y_pred") -> DataFrame:
    """Bootstrap mean and 2.5/97.5 % interval of binary macro-F1 and attack recall.

    Resampling n rows with replacement only changes the four confusion
    cells, whose joint law is Multinomial(n, cell shares); replicates are
    drawn from that in parallel (``n_boot`` rows), so the cost does not
    depend on the number of prediction rows.
    """
    cells = binary_metrics(pred, y, yhat).select(
        "true_negative", "false_positive", "false_negative", "true_positive").first()
    counts = [int(cells[0]), int(cells[1]), int(cells[2]), int(cells[3])]
    spark = pred.sparkSession

    def draw(it):
        import numpy as np
        import pandas as pd
        total = sum(counts)
        probs = np.array(counts, dtype=float) / max(total, 1)
        for part in it:
            out = []
            for r in part["id"].to_numpy():
                rng = np.random.default_rng([seed, int(r)])
                tn, fp, fn, tp = rng.multinomial(total, probs)
                f_a = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
                f_n = 2 * tn / (2 * tn + fp + fn) if (2 * tn + fp + fn) else 0.0
                rec = tp / (tp + fn) if (tp + fn) else 0.0
                out.append((int(r), (f_a + f_n) / 2.0, rec))
            yield pd.DataFrame(out, columns=["replicate", "macro_f1", "attack_recall"])

    reps = spark.range(n_boot).mapInPandas(draw, "replicate long, macro_f1 double, attack_recall double")
    long = reps.select(F.explode(F.array(
        F.struct(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("v")),
        F.struct(F.lit("attack_recall").alias("metric"), F.col("attack_recall").alias("v")))).alias("m"))
    return long.groupBy(F.col("m.metric").alias("metric")).agg(
        F.avg("m.v").alias("mean"),
        F.percentile(F.col("m.v"), 0.025).alias("ci_low"),
        F.percentile(F.col("m.v"), 0.975).alias("ci_high"),
        F.count(F.lit(1)).alias("n_bootstrap"))
