"""Evaluation layer against hand-computed values (FIXTURES §1.3-1.4)."""

import pytest
from pyspark.sql import functions as F

from flowlab.operators import evaluate as E


def _pred(spark, rows, cols="y_true int, y_pred int, score double"):
    return spark.createDataFrame(rows, cols)


def test_binary_bundle(spark):
    # 3 true negatives, 1 false positive, 2 false negatives, 4 true positives
    rows = [(0, 0, 0.2)] * 3 + [(0, 1, 0.55)] + [(1, 0, 0.45), (1, 0, 0.1)] + [(1, 1, 0.9)] * 4
    p = _pred(spark, rows)
    m = E.metric_bundle(p, ["normal", "attack"]).first()
    assert m.accuracy == pytest.approx(0.7)
    assert m.macro_f1 == pytest.approx((2 * 3 / 9 + 2 * 4 / 11) / 2)
    st = {r.class_name: r for r in E.class_stats(p, ["normal", "attack"]).collect()}
    assert (st["attack"].precision, st["attack"].recall) == (pytest.approx(4 / 5), pytest.approx(4 / 6))
    assert (st["normal"].precision, st["normal"].recall) == (pytest.approx(3 / 5), pytest.approx(3 / 4))
    auc = E.binary_auc(p, "score", "y_true").first()
    pos, neg = [s for y, _, s in rows if y], [s for y, _, s in rows if not y]
    assert auc.roc_auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 24)


def test_auc_with_ties_and_step_ap(spark):
    # 6-row sample: exact AP is a step sum, not the trapezoid
    rows = [(0, 0, 0.1), (1, 0, 0.4), (0, 0, 0.35), (1, 1, 0.8), (0, 1, 0.7), (1, 1, 0.9)]
    p = _pred(spark, rows)
    r = E.binary_auc(p, "score", "y_true", buckets=3).first()
    pos = [s for y, _, s in rows if y == 1]
    neg = [s for y, _, s in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert r.roc_auc == pytest.approx(auc)
    # AP: thresholds 0.9, 0.8, 0.7, 0.4, 0.35, 0.1 -> precision at each positive
    assert r.pr_auc == pytest.approx((1 + 1 + 3 / 4) / 3)


def test_auc_rejects_multiclass(spark):
    p = _pred(spark, [(0, 0, 0.1), (1, 1, 0.2), (2, 2, 0.3), (1, 0, 0.4)])
    with pytest.raises(ValueError):
        E.binary_auc(p, "score", "y_true")


def test_confusion_full_grid(spark):
    p = _pred(spark, [(0, 0, 0.0), (1, 1, 0.0), (2, 2, 0.0), (1, 0, 0.0)])
    cm = E.confusion(p, ["a", "b", "c"]).collect()
    assert len(cm) == 9
    cell = {(r.y_true, r.y_pred): (r.n, r.rate) for r in cm}
    assert cell[(1, 0)] == (1, 0.5)
    assert cell[(0, 2)] == (0, 0.0)


def test_present_only_macro(spark):
    # five rows, three classes declared, class 2 never seen
    p = _pred(spark, [(0, 0, 0.0), (0, 1, 0.0), (1, 1, 0.0), (1, 1, 0.0), (1, 0, 0.0)])
    declared = E.metric_bundle(p, ["a", "b", "c"]).first().macro_f1
    present = E.metric_bundle(p, ["a", "b", "c"], present_only=True).first().macro_f1
    assert present == pytest.approx(declared * 3 / 2)


def test_threshold_sweep_beta2(spark):
    p = spark.createDataFrame([(0, 0.10), (0, 0.40), (1, 0.35), (1, 0.90)], "y_true int, score double")
    sw = E.threshold_sweep(p, beta=2.0, thresholds=[0.30, 0.50])
    best = E.best_candidate(sw, "score").first()
    assert best.threshold == pytest.approx(0.30)


def test_best_candidate_empty_raises(spark):
    empty = spark.createDataFrame([], "position int, score double")
    with pytest.raises(ValueError):
        E.best_candidate(empty, "score")


def test_fp_per_10k_and_family_recall(spark):
    p = spark.createDataFrame([(0, 0, "normal"), (0, 1, "normal"), (1, 1, "DoS"), (1, 0, "R2L"), (1, 1, "U2R")],
                              "y_true int, y_pred int, attack_family string")
    assert E.fp_per_10k_benign(p).first()[0] == pytest.approx(5000.0)
    fr = {r.family: r.recall for r in E.family_recall(p, ["normal", "DoS", "Probe", "R2L", "U2R"]).collect()}
    assert fr == {"normal": 0.5, "DoS": 1.0, "Probe": 0.0, "R2L": 0.0, "U2R": 1.0}


def test_alert_workload(spark):
    r = spark.createDataFrame([(0.99, 0.80)], "normal_recall double, attack_recall double")
    w = E.alert_workload(r, 1_000_000, 0.005).first()
    assert w.false_alerts_per_day == pytest.approx(9950.0)
    assert w.true_alerts_per_day == pytest.approx(4000.0)
    assert w.missed_attacks_per_day == pytest.approx(1000.0)


def test_rare_recall_requires_classes(spark):
    p = _pred(spark, [(0, 0, 0.0), (1, 1, 0.0)])
    row = E.metric_row(p, ["a", "b"])
    with pytest.raises(ValueError):
        E.rare_recall_mean(row, [])
    assert E.rare_recall_mean(row, ["b"]).first()[0] == pytest.approx(1.0)


def test_bootstrap_ci_shape(spark):
    p = _pred(spark, [(i % 2, (i // 2) % 2, 0.0) for i in range(40)])
    ci = {r.metric: r for r in E.bootstrap_ci(p, 50, 7).collect()}
    assert set(ci) == {"macro_f1", "attack_recall"}
    assert all(r.ci_low <= r.mean <= r.ci_high and r.n_bootstrap == 50 for r in ci.values())


def test_auc_binned_close_to_exact(spark):
    import numpy as np
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 2000)
    s = np.clip(rng.normal(0.4 + 0.2 * y, 0.15), 0, 1)
    p = spark.createDataFrame([(int(a), 0, float(b)) for a, b in zip(y, s)], "y_true int, y_pred int, score double")
    exact = E.binary_auc(p, "score", "y_true").first().roc_auc
    binned = E.binary_auc(p, "score", "y_true", bins=1000).first().roc_auc
    assert abs(exact - binned) < 2e-3
