"""The registered tree fits use the library's rounds."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rankwell.operators import fit
from rankwell.plans.catalog import load_all


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["tree_model", "family_ablation", "feature_importance", "model_ladder"])
def test_registered_tree_fits_are_not_cut(spark, monkeypatch, name):
    class Booster:
        def __init__(self, **settings):
            raise Seen(settings["maxIter"])

    monkeypatch.setattr(fit, "GBTClassifier", Booster)
    if name == "model_ladder":  # its text model is fitted first
        monkeypatch.setattr(fit, "fit_text", lambda *_, **__: None)
    with pytest.raises(Seen) as seen:
        load_all()[name].run(spark, "/root/testdata/sf0.001")
    assert seen.value.args == (300,)


def test_text_model_scores_in_a_session_that_observed_rows(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    rows = [(f"good fine word{i % 3}", "1") for i in range(6)] + [(f"bad poor word{i % 3}", "0") for i in range(6)]
    train = spark.createDataFrame(rows, "code string, time_class string")
    model = fit.fit_text(train, "code", "time_class", ("0", "1"), max_iter=20)
    assert model.score(train).filter(F.col("answer") == F.col("time_class")).count() == 12


@pytest.mark.parametrize("most", [1, 60, 700, 5000])
def test_vocabulary_is_cut_without_one_task_for_all(spark, monkeypatch, most):
    monkeypatch.setattr(fit.most_frequent, "__defaults__", (50,))
    texts = [" ".join(f"w{(i * 7 + j * j) % 90}x" for j in range(12)) for i in range(40)]
    frame = spark.createDataFrame([(t,) for t in texts], "code string").repartition(3)
    seen = {}
    for t in texts:
        w = t.split()
        for gram in {" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}:
            seen[gram] = seen.get(gram, 0) + 1
    want = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]
    got = fit.vocabulary(frame, "code", most)
    assert [tuple(r) for r in got.collect()] == want
    assert "TakeOrderedAndProject" not in got._jdf.queryExecution().executedPlan().toString()


def test_trees_fit_on_one_row_per_class_and_bins(spark, monkeypatch):
    fitted = {}

    class Booster(fit.GBTClassifier):
        def fit(self, rows):
            fitted["rows"], fitted["weight"] = rows.count(), rows.agg(F.sum("weight")).first()[0]
            return super().fit(rows)

    monkeypatch.setattr(fit, "GBTClassifier", Booster)
    frame = spark.range(4000).select(
        (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 1000).cast("double").alias("y"),
        F.when((F.col("id") % 5 < 2) != (F.col("id") % 1000 < 700), "1").otherwise("0").alias("c"),
    )
    model = fit.fit_trees(frame, "c", ("0", "1"), ["x", "y"], rounds=5)
    assert fitted["rows"] <= 2 * 5 * fit.TREE_BINS
    assert abs(fitted["weight"] - 4000) < 1e-6
    right = model.score(frame).filter(F.col("answer") == F.col("c")).count()
    assert right > 3900


def test_bin_ends_hold_equal_shares_and_split_after_heavy_values():
    assert fit.bin_ends([float(i) for i in range(1000)], 4) == [250.0, 500.0, 750.0]
    assert fit.bin_ends([0.0] * 900 + [float(i) for i in range(1, 101)], 4)[-1] > 1
    assert fit.bin_ends([1.0] * 50) == []
    assert fit.bin_ends([0.0, 1.0] * 50) == [1.0]
    assert fit.bin_ends([]) == []
