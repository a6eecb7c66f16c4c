"""Temperature, calibration errors and conformal sets against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.functions import scores as sc
from rankwell.operators import uncertain

CLASSES = tuple(f"c{i}" for i in range(5))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        truth = int(rng.integers(0, 5))
        s = rng.normal(0, 1, 5)
        s[truth] += 1.2
        rows.append((i, [float(x) for x in s], truth, f"c{truth}"))
    return spark.createDataFrame(rows, "id long, scores array<double>, true_rank int, true_label string")


def interval(p, target=None, reach=None):
    lo = hi = int(np.argmax(p))
    mass = p[lo]
    while (mass < target) if reach is None else not lo <= reach <= hi:
        if lo == 0 and hi == len(p) - 1:
            break
        left = p[lo - 1] if lo > 0 else -1
        right = p[hi + 1] if hi < len(p) - 1 else -1
        lo, hi = (lo - 1, hi) if left >= right else (lo, hi + 1)
        mass += max(left, right)
    return lo, hi, mass


def test_conformal_matches_numpy(spark, scored):
    proba = uncertain.with_probabilities(scored).persist()
    val, test = proba.filter("id < 300"), proba.filter("id >= 300")
    rows = val.collect()
    masses = np.array([interval(np.array(r.proba), reach=r.true_rank)[2] for r in rows])
    n = len(masses)
    fitted = uncertain.fit_conformal(val, CLASSES).first().mass_threshold_by_alpha
    for alpha in uncertain.ALPHAS:
        q = min(1.0, np.ceil((n + 1) * (1 - alpha)) / n)
        want = np.quantile(masses, q, method="higher")
        assert fitted[f"{alpha:.2f}"] == pytest.approx(want, abs=1e-12)
    thresholds = uncertain.fit_conformal(val, CLASSES)
    sets = uncertain.with_prediction_set(test, thresholds, CLASSES, 0.10).collect()
    for r in sets:
        lo, hi, _ = interval(np.array(r.proba), target=fitted["0.10"])
        assert r.conformal_set == list(CLASSES[lo : hi + 1])
        assert CLASSES[int(np.argmax(r.proba))] in r.conformal_set
    coverage = {r.alpha: r.empirical_coverage for r in
                uncertain.risk_coverage(test, thresholds, CLASSES).collect()}
    assert coverage[0.05] >= 0.90 and coverage[0.20] >= 0.72
    with pytest.raises(Exception, match="no threshold was fitted"):
        uncertain.with_prediction_set(test, thresholds, CLASSES, 0.33).collect()


def test_temperature_finds_a_minimum_and_keeps_the_argmax(scored):
    rows = scored.collect()
    s, y = np.array([r.scores for r in rows]), np.array([r.true_rank for r in rows])

    def loss(t):
        z = s / t - (s / t).max(axis=1, keepdims=True)
        return -np.mean(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1)))

    t, at = uncertain.fit_temperature(scored)
    assert at == pytest.approx(loss(t)) and at <= min(loss(t * 0.99), loss(t * 1.01))
    a = uncertain.with_prediction(uncertain.with_probabilities(scored, t), CLASSES)
    b = uncertain.with_prediction(uncertain.with_probabilities(scored, 1.0), CLASSES)
    assert a.select("id", "answer").exceptAll(b.select("id", "answer")).isEmpty()


def test_the_two_binnings_differ_on_edges(spark):
    rows = [(0.0, 0, 0), (0.1, 0, 1), (0.3, 2, 3), (0.55, 5, 5), (1.0, 9, 9)]
    frame = spark.createDataFrame(rows, "c double, right_closed int, left_closed int")
    for r in frame.select("*", sc.right_closed_bin(F.col("c")).alias("a"),
                          sc.left_closed_bin(F.col("c")).alias("b")).collect():
        assert (r.a, r.b) == (r.right_closed, r.left_closed)


def test_empty_summary_is_zero(spark):
    empty = spark.createDataFrame(
        [], "confidence double, correct boolean, covered boolean, set_size int, abstained boolean"
    )
    row = uncertain.calibration_summary(empty).first()
    assert row.n == 0 and row.ece == 0.0 and row.coverage == 0.0


def test_even_spread(spark):
    row = spark.range(1).select(
        sc.even_spread(F.lit("c1"), F.lit(0.8), CLASSES).alias("d")
    ).first()
    assert row.d == {"c0": 0.05, "c1": 0.8, "c2": 0.05, "c3": 0.05, "c4": 0.05}


def test_ordinal_loss_prefers_neighbours(spark):
    rows = [([2.0, 0.0, 0.0], 0), ([0.0, 2.0, 0.0], 0), ([0.0, 0.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, "s array<double>, t int")
    losses = [r.x for r in frame.select(sc.ordinal_loss(F.col("s"), F.col("t")).alias("x")).collect()]
    assert losses[0] < losses[1] < losses[2]
