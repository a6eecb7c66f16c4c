"""Metrics, intervals, promotion, audits and expressions on hand-sized inputs."""

import pytest
from pyspark.sql import functions as F

from rankwell.functions.expressions import expr_rejected, normalize_expr
from rankwell.functions.ordinal import TIME_CLASSES
from rankwell.functions.stats import laplace, wilson_high, wilson_low
from rankwell.operators import judge, predictors


def answers(spark, rows):
    return spark.createDataFrame(rows, "label string, answer string")


def test_metrics_over_the_full_class_list(spark):
    rows = answers(spark, [("O(1)", "O(1)"), ("O(1)", "O(n)"), ("O(n)", "O(n)"), ("O(n^2)", "O(1)")])
    got = judge.metrics(rows, TIME_CLASSES).first()
    # F1: O(1) 0.5, O(n) 2/3, the other five classes 0
    assert got.n == 4 and got.accuracy == 0.5
    assert got.macro_f1 == pytest.approx((0.5 + 2 / 3) / 7)
    assert got.mean_ordinal_distance == pytest.approx((0 + 2 + 0 + 4) / 4)


def test_empty_metrics_are_an_error(spark):
    with pytest.raises(Exception, match="at least one example"):
        judge.metrics(answers(spark, []), TIME_CLASSES).collect()


def test_wilson_edges(spark):
    row = spark.range(1).select(
        wilson_low(F.lit(0), F.lit(0)).alias("a"), wilson_high(F.lit(0), F.lit(0)).alias("b"),
        wilson_low(F.lit(122), F.lit(144)).alias("c"), wilson_high(F.lit(122), F.lit(144)).alias("d"),
        wilson_high(F.lit(9), F.lit(9)).alias("e"), laplace(F.lit(104), F.lit(112)).alias("f"),
    ).first()
    assert (row.a, row.b, row.e) == (0.0, 1.0, 1.0)
    assert round(row.c, 2) == 0.78 and round(row.d, 2) == 0.90
    assert row.f == pytest.approx(105 / 114)


def test_promotion_needs_rows_and_distance(spark):
    rows = []
    for language, n, engine, model in (("a", 40, 4, 38), ("b", 10, 0, 10), ("c", 40, 20, 24)):
        for i in range(n):
            for name, right in (("rule", i < engine), ("model", i < model)):
                rows.append((language, "certain", "time", name, "x", "x" if right else None))
    frame = spark.createDataFrame(
        rows, "language string, certainty string, dimension string, predictor string, "
        "label string, answer string",
    )
    got = {r.slice: (r.answers, r.reason) for r in judge.promotion(frame, "rule", "model").collect()}
    assert got["a/certain"] == ("model", judge.PROMOTED)
    assert got["b/certain"] == ("engine", judge.TOO_FEW.format(20))
    assert got["c/certain"] == ("engine", judge.NOT_BETTER)


def test_tally_null_rules(spark):
    frame = spark.createDataFrame(
        [("k", None, "x"), ("k", "x", None), ("k", "x", "x")], "key string, label string, answer string"
    )
    row = judge.tally(frame, ["key"]).first()
    assert (row.correct, row.total) == (1, 2)


def test_label_audit_of_five_rows(spark):
    rows = [("random", "high", c, e, a) for c, e, a in
            [("x", "x", "x"), ("x", "y", "x"), ("x", "y", "y"), ("x", "y", "z"), (None, "y", "y")]]
    frame = spark.createDataFrame(
        [(k, "s", conf, c, e, a, None, None, None) for k, conf, c, e, a in rows],
        "kind string, source string, confidence string, corpus_time string, engine_time string, "
        "agent_time string, corpus_space string, engine_space string, agent_space string",
    )
    got = {r.measure: r.n for r in judge.label_audit(frame).filter("table = 'random'").collect()}
    assert got == {"rows": 4, "corpus_right": 2, "engine_right": 2, "both_right": 1, "neither_right": 1}


@pytest.mark.parametrize(("a", "b", "same"), [
    ("O(m * n)", "O(n * m)", True),
    ("O(m log n)", "O(n log m)", False),
    ("O(n log n)", "O(log(n)*n)", True),
    ("O((a + b) * n)", "O(n*(b+a))", True),
    ("O((n + m)^2)", "O((m + n)^2)", False),
    ("O(n + m)", "O(n * m)", False),
])
def test_expressions(spark, a, b, same):
    row = spark.range(1).select(
        (normalize_expr(F.lit(a)) == normalize_expr(F.lit(b))).alias("same"),
        expr_rejected(F.lit(a)).alias("bad"),
    ).first()
    assert row.same is same and row.bad is False


@pytest.mark.parametrize(("text", "want"), [
    ("O(n log\tm)", "log(m)*n"), ("log log n", "log(log)*n"), ("log  2", "2*log"), ("2log n", "2log*n"),
    ("sqrt n + log", "log+sqrt(n)"), ("log(n) log k", "log(k)*log(n)"), ("log \u00e9", "log(\u00e9)"), ("log", "log")])
def test_functions_take_the_name_behind_them(spark, text, want):
    assert spark.range(1).select(normalize_expr(F.lit(text)).alias("x")).first().x == want


def test_consistency_counts_null_pairs(spark):
    columns = ("case_id, language, known_limitation, has_overrides, error, answer_time, "
               "answer_space, time_ok, space_ok")
    types = ("string", "string", "boolean", "boolean", "string", "string", "string", "boolean", "boolean")
    schema = ", ".join(f"{c} {t}" for c, t in zip(columns.split(", "), types, strict=True))
    rows = [("a", "x", False, False, None, "1", None, True, True),
            ("a", "y", False, False, None, "1", None, True, True),
            ("b", "x", False, False, None, "1", None, True, False),
            ("b", "y", False, False, None, "1", "2", True, True),
            ("c", "x", False, False, None, "1", "2", True, True)]
    row = judge.cross_language_consistency(spark.createDataFrame(rows, schema)).first()
    assert (row.cases, row.consistent, row.correct) == (2, 0.5, 0.5)


def test_ratchet(spark):
    pairs = lambda xs: spark.createDataFrame([("time", x) for x in xs], "metric string, pair string")
    got = {(r.change, r.pair) for r in judge.ratchet(pairs("abc"), pairs("bcd")).collect()}
    assert got == {("improvement", "a"), ("regression", "d")}


def test_unknown_predictor_lists_the_known():
    predictors.register_predictor("known", lambda f: None)
    with pytest.raises(KeyError, match="known"):
        predictors.get_predictor("nobody")


def test_hybrid_modes(spark):
    cases = spark.createDataFrame(
        [(1, "certain", None), (2, "unknown", None), (3, "certain", "E: x")],
        "case_id long, certainty string, primary_error string",
    ).selectExpr("*", "'p' primary_time", "'p' primary_space", "'f' fallback_time", "'f' fallback_space")
    got = {r.case_id: (r.engine, r.answer_time, len(r.warnings)) for r in predictors.hybrid(cases).collect()}
    assert got == {1: ("symbolic", "p", 0), 2: ("ml_fallback", "f", 1), 3: ("ml_fallback", "f", 1)}
    assert {r.engine for r in predictors.hybrid(cases, mode="ml").collect()} == {"ml"}
    with pytest.raises(ValueError):
        predictors.hybrid(cases, mode="other")


def test_a_missing_answer_lowers_the_readout(spark, monkeypatch):
    from rankwell.plans import judging_queries as plans

    low, high = plans.PRIORITIES[:2]
    rows = [("time", "rule", "certain", c, c) for c in (low, high)]
    rows += [("time", "model", "certain", c, a) for c, a in ((low, low), (high, high), (high, None))]
    table = spark.createDataFrame(
        rows, "dimension string, predictor string, certainty string, label string, answer string"
    )
    monkeypatch.setattr(plans, "answers", lambda *_: table)
    got = plans._readout(spark, "").first()
    assert got.winner == "time/rule/certain"
    assert got["drop"] == pytest.approx(1 / 3 / len(plans.PRIORITIES), abs=1e-5)
