"""Judging ordinal predictors: metrics, tallies, promotion and scorecards.

Answers come in long form, one row per case, dimension and predictor, with a
``label`` and an ``answer``.  A NULL label skips the row; a NULL answer is wrong.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions.expressions import normalize_expr
from rankwell.functions.ordinal import class_array, ordinal_distance
from rankwell.functions.stats import laplace, share, wilson_high, wilson_low

#: Rows needed before a challenger may answer a slice, and the reasons.
MIN_ROWS = 20
PROMOTED = "model's interval is above the engine's"
NOT_BETTER = "model not better beyond the noise of the sample"
TOO_FEW = "fewer than {} rows: the engine stays the default"
SERVED_LEVELS = ("certain", "assumed")
ALL_LEVELS = ("certain", "assumed", "unknown")


def rows() -> Column:
    return F.count(F.lit(1))


def hit(answer: Column, label: Column) -> Column:
    return F.coalesce(answer == label, F.lit(False))


# ---------------------------------------------------------------------- metrics
def confusion_counts(
    frame: DataFrame, by: Sequence[str] = (), label: str = "label", answer: str = "answer"
) -> DataFrame:
    """(by, label, answer, n): at most k*k rows per group, the base of every metric."""
    return frame.groupBy(*by, label, answer).agg(rows().alias("n"))


def class_scores(confusion: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Support, predicted, true positives and F1 for every class of the full list."""
    right = F.col("label") == F.col("answer")
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(right, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("answer").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )
    zero = F.lit(0).cast("bigint")
    grid = F.transform(
        class_array(classes),
        lambda c: F.struct(c.alias("class"), zero.alias("support"), zero.alias("predicted"),
                           zero.alias("tp")),
    )
    # every group carries the whole class list, so absent classes count as 0
    cells = confusion.select(*by, F.inline(roles)).unionByName(
        confusion.select(*by).distinct().select(*by, F.inline(grid))
    )
    total = F.col("support") + F.col("predicted")
    return (
        cells.filter(F.col("class").isin(*classes))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
        .withColumn("f1", F.when(total > 0, 2 * F.col("tp") / total).otherwise(0.0))
    )


def metrics(
    frame: DataFrame,
    classes: Sequence[str],
    by: Sequence[str] = (),
    label: str = "label",
    answer: str = "answer",
) -> DataFrame:
    """n, accuracy, macro-F1 over the full class list, and mean ordinal distance.

    The input is read once; F1 is computed from the small confusion table.  A missing
    answer, or one outside the list, is wrong by the whole scale.  An empty ungrouped
    input is an error.
    """
    confusion = confusion_counts(
        frame.select(*by, F.col(label).alias("label"), F.col(answer).alias("answer")), by
    )
    n = F.sum("n")
    if not by:
        n = F.when(n.isNull(), F.raise_error(F.lit("metrics need at least one example"))).otherwise(n)
    distance = F.coalesce(
        ordinal_distance(F.col("label"), F.col("answer"), classes), F.lit(len(classes) - 1)
    )
    # per-class counts as one conditional sum per class: k is a short fixed list
    f1 = []
    for c in classes:
        tp = F.sum(F.when((F.col("label") == c) & (F.col("answer") == c), F.col("n")).otherwise(0))
        both = F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)) + F.sum(
            F.when(F.col("answer") == c, F.col("n")).otherwise(0)
        )
        f1.append(F.when(both > 0, 2 * tp / both).otherwise(0.0))
    return confusion.groupBy(*by).agg(
        n.alias("n"),
        (F.sum(F.when(F.col("label") == F.col("answer"), F.col("n")).otherwise(0)) / F.sum("n")).alias(
            "accuracy"
        ),
        (sum(f1[1:], f1[0]) / len(classes)).alias("macro_f1"),
        (F.sum(distance * F.col("n")) / F.sum("n")).alias("mean_ordinal_distance"),
    )


def confusion_matrix(
    frame: DataFrame, classes: Sequence[str], by: Sequence[str] = (), recall: bool = False
) -> DataFrame:
    """One row per true class of the full list, one column per predicted class.

    For ``recall`` a missing answer, or one outside the list, counts among the rows of its
    true class.
    """
    none = "no class"
    known = F.when(F.col("answer").isin(*classes), F.col("answer")).otherwise(none)
    scored = frame.filter(F.col("label").isNotNull()).withColumn("answer", known)
    wide = scored.groupBy(*by, "label").pivot("answer", [*classes, none]).agg(rows())
    if not by:
        grid = frame.sparkSession.createDataFrame([(c,) for c in classes], "label string")
        wide = grid.join(wide, "label", "left")
    missing = F.coalesce(F.col(f"`{none}`"), F.lit(0)).alias(none)
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in classes]
    if not recall:
        return wide.select(*by, "label", *cells)
    wide = wide.select(*by, "label", *cells, missing)
    total = sum((F.col(f"`{c}`") for c in classes), F.col(f"`{none}`"))
    return wide.select(
        *by, "label", *[share(F.col(f"`{c}`"), total).alias(c) for c in classes]
    )


# --------------------------------------------------------------- tallies, promotion
def tally(answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correct and total per key; rows without a label are skipped."""
    return (
        answers.filter(F.col("label").isNotNull())
        .groupBy(*by)
        .agg(
            F.count_if(hit(F.col("answer"), F.col("label"))).alias("correct"),
            rows().alias("total"),
        )
    )


def with_interval(tallies: DataFrame, digits: int | None = None) -> DataFrame:
    low = wilson_low(F.col("correct"), F.col("total"))
    high = wilson_high(F.col("correct"), F.col("total"))
    if digits is not None:
        low, high = F.round(low, digits), F.round(high, digits)
    return tallies.withColumn("low", low).withColumn("high", high)


def promotion(
    answers: DataFrame,
    incumbent: str,
    challenger: str,
    slice_by: Sequence[str] = ("language", "certainty"),
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Who answers each slice: the challenger only when better beyond the noise.

    Both predictors are counted in one aggregation, so no join is needed and a
    slice seen by one side only has 0 of 0 on the other.
    """
    slice_key = F.concat_ws("/", *slice_by).alias("slice")
    right = hit(F.col("answer"), F.col("label"))
    sums = []
    for prefix, name in (("engine", incumbent), ("model", challenger)):
        mine = F.col("predictor") == name
        sums += [
            F.count_if(mine & right).alias(f"{prefix}_correct"),
            F.count_if(mine).alias(f"{prefix}_total"),
        ]
    counted = (
        answers.filter(F.col("label").isNotNull() & F.col("predictor").isin(incumbent, challenger))
        .select(slice_key, "dimension", "predictor", "answer", "label")
        .groupBy("slice", "dimension")
        .agg(*sums)
    )
    bounds = {
        f"{prefix}_{side}": bound(F.col(f"{prefix}_correct"), F.col(f"{prefix}_total"))
        for prefix in ("engine", "model")
        for side, bound in (("low", wilson_low), ("high", wilson_high))
    }
    counted = counted.withColumns(bounds)
    enough = F.col("engine_total") >= min_rows
    promoted = enough & (F.col("model_low") > F.col("engine_high"))
    return counted.select(
        "slice",
        "dimension",
        F.col("engine_total").alias("rows"),
        "engine_correct", "engine_total",
        F.round("engine_low", 3).alias("engine_low"),
        F.round("engine_high", 3).alias("engine_high"),
        "model_correct", "model_total",
        F.round("model_low", 3).alias("model_low"),
        F.round("model_high", 3).alias("model_high"),
        F.when(promoted, "model").otherwise("engine").alias("answers"),
        F.when(promoted, PROMOTED)
        .when(enough, NOT_BETTER)
        .otherwise(TOO_FEW.format(min_rows))
        .alias("reason"),
    )


def missing_predictions(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Truth rows that never got a prediction."""
    return truth.join(predictions.select(key), key, "left_anti")


def score_predictions(
    truth: DataFrame, predictions: DataFrame, key: str, classes: Sequence[str]
) -> DataFrame:
    """Metrics over the ids both sides know."""
    return metrics(truth.join(predictions, key), classes)


def hash_verified(records: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit entries whose record is found with exactly the recorded content hash.

    The wanted keys prune the corpus before any text is hashed or shuffled.
    """
    wanted = audit.filter((F.col("kind") == "random") & (F.col("confidence") != "low"))
    keyed = records.withColumn("id", F.concat_ws(":", "source", "solution_id"))
    hashed = keyed.join(wanted.select("id"), "id", "left_semi").select(
        "id", F.col("language"), F.sha2("code", 256).alias("sha256")
    )
    return wanted.join(hashed, ["id", "sha256"])


def passing_pairs(answers: DataFrame, predictor: str) -> DataFrame:
    """(metric, pair) the predictor gets right."""
    mine = answers.filter(F.col("predictor") == predictor)
    return mine.filter(F.col("answer") == F.col("label")).select(
        F.col("dimension").alias("metric"),
        F.concat_ws(":", "case_id", "language").alias("pair"),
    )


def ratchet(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Pairs right before and wrong now, and the other way round, in one pass.

    Both sets are tagged and grouped, so each is shuffled once for both answers.
    """
    tagged = current.select("metric", "pair", F.lit(1).alias("side")).unionByName(
        baseline.select("metric", "pair", F.lit(2).alias("side"))
    )
    return (
        tagged.groupBy("metric", "pair")
        .agg(F.bit_or("side").alias("sides"))
        .filter(F.col("sides") != 3)
        .select(
            F.when(F.col("sides") == 2, "regression").otherwise("improvement").alias("change"),
            "metric",
            "pair",
        )
    )


# -------------------------------------------------------------------- certainty
def certainty_levels(cases: DataFrame, levels: Sequence[str] = SERVED_LEVELS) -> DataFrame:
    """Correct and total per served level and dimension, all cells present.

    ``cases`` has ``certainty``, ``label_*`` and ``answer_*`` for both dimensions.
    """
    counted = _by_dimension(cases).filter(F.col("certainty").isin(*levels)).groupBy(
        "certainty", "dimension"
    ).agg(F.count_if("right").alias("correct"), rows().alias("total"))
    grid = cases.sparkSession.createDataFrame(
        [(c, d) for c in levels for d in ("time", "space")], "certainty string, dimension string"
    )
    zero = F.lit(0).cast("bigint")
    return grid.join(counted, ["certainty", "dimension"], "left").select(
        "certainty", "dimension",
        F.coalesce("correct", zero).alias("correct"),
        F.coalesce("total", zero).alias("total"),
    )


def _by_dimension(cases: DataFrame) -> DataFrame:
    parts = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                F.col(f"label_{d}").alias("label"),
                hit(F.col(f"answer_{d}"), F.col(f"label_{d}")).alias("right"),
            )
            for d in ("time", "space")
        ]
    )
    keep = [c for c in cases.columns if not c.startswith(("label_", "answer_"))]
    return cases.select(*keep, F.inline(parts))


def with_confidence(levels: DataFrame) -> DataFrame:
    return levels.withColumn("confidence", laplace(F.col("correct"), F.col("total")))


def calibration_payload(cases: DataFrame) -> DataFrame:
    """Certainty histogram and joint accuracy by language, as (part, key, correct, total)."""
    histogram = cases.groupBy(F.coalesce("certainty", F.lit("missing")).alias("key")).agg(
        F.lit(None).cast("bigint").alias("correct"), rows().alias("total")
    ).select(F.lit("certainty_counts").alias("part"), "key", "correct", "total")
    both = hit(F.col("answer_time"), F.col("label_time")) & hit(
        F.col("answer_space"), F.col("label_space")
    )
    joint = (
        cases.filter(F.col("certainty").isin(*SERVED_LEVELS))
        .groupBy(F.col("language").alias("key"))
        .agg(F.count_if(both).alias("correct"), rows().alias("total"))
        .select(F.lit("joint_accuracy_by_language").alias("part"), "key", "correct", "total")
    )
    return histogram.unionByName(joint)


def first_contact_agreement(cases: DataFrame) -> DataFrame:
    """Agreement with the labels by certainty; errors are left out, absent cells are 0 of 0."""
    usable = cases.filter((F.col("certainty") != "error"))
    long = _by_dimension(usable).filter(F.col("label").isNotNull())
    counted = long.groupBy("dimension", "certainty").agg(
        F.count_if("right").alias("correct"), rows().alias("total")
    )
    grid = cases.sparkSession.createDataFrame(
        [(d, c, i) for d in ("time", "space") for i, c in enumerate(ALL_LEVELS)],
        "dimension string, certainty string, position int",
    )
    zero = F.lit(0).cast("bigint")
    return grid.join(counted, ["dimension", "certainty"], "left").select(
        "dimension", "position", "certainty",
        F.coalesce("correct", zero).alias("correct"),
        F.coalesce("total", zero).alias("total"),
    )


def label_audit(entries: DataFrame) -> DataFrame:
    """Three-way agreement of corpus label, engine and independent reading.

    One aggregation gives the random-sample table, the disagreement table and
    the corpus accuracy by source, as (table, dimension, source, measure, n).
    """
    parts = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                F.col(f"corpus_{d}").alias("corpus"),
                F.col(f"engine_{d}").alias("engine"),
                F.col(f"agent_{d}").alias("agent"),
            )
            for d in ("time", "space")
        ]
    )
    long = (
        entries.filter(F.col("confidence") != "low")
        .select("kind", "source", F.inline(parts))
        .filter(F.col("corpus").isNotNull())
    )
    corpus_ok = F.col("corpus").eqNullSafe(F.col("agent"))
    engine_ok = F.col("engine").eqNullSafe(F.col("agent"))
    counted = long.groupBy("kind", "dimension", "source").agg(
        rows().alias("rows"),
        F.count_if(corpus_ok).alias("corpus_right"),
        F.count_if(engine_ok).alias("engine_right"),
        F.count_if(corpus_ok & engine_ok).alias("both_right"),
        F.count_if(~corpus_ok & ~engine_ok).alias("neither_right"),
        F.count_if(~engine_ok & corpus_ok).alias("only_corpus_right"),
    )
    random = F.col("kind") == "random"

    def cells(table: str, source: Column, measures: Mapping[str, str]) -> list[Column]:
        return [
            F.struct(
                F.lit(table).alias("table"), source.alias("source"),
                F.lit(m).alias("measure"), F.col(c).alias("n"),
            )
            for m, c in measures.items()
        ]

    names = ("rows", "corpus_right", "engine_right", "both_right", "neither_right")
    everywhere = F.lit("all")
    chosen = F.when(
        random,
        F.array(
            *cells("random", everywhere, {n: n for n in names}),
            *cells("by_source", F.col("source"), {"rows": "rows", "corpus_right": "corpus_right"}),
        ),
    ).otherwise(
        F.array(
            *cells(
                "disagreement", everywhere,
                {"rows": "rows", "engine_right": "engine_right",
                 "corpus_right": "only_corpus_right", "neither": "neither_right"},
            )
        )
    )
    return (
        counted.select("dimension", F.inline(chosen))
        .groupBy("table", "dimension", "source", "measure")
        .agg(F.sum("n").alias("n"))
    )


# --------------------------------------------------------------------- scorecard
def case_results(cases: DataFrame, time_classes: Sequence[str], space_classes: Sequence[str]) -> DataFrame:
    """Per case and language: hits, rank errors (a missing answer costs the whole scale)."""

    def rank_error(dimension: str, classes: Sequence[str]) -> Column:
        distance = ordinal_distance(
            F.col(f"answer_{dimension}"), F.col(f"expected_{dimension}"), classes
        )
        return F.when(F.col(f"answer_{dimension}").isNull(), float(len(classes))).otherwise(
            distance.cast("double")
        )

    def expr_ok(dimension: str) -> Column:
        got, want = F.col(f"answer_{dimension}_expr"), F.col(f"expected_{dimension}_expr")
        # equal spellings need no normal form
        return F.when(got == want, True).when(
            got.isNotNull(), normalize_expr(got) == normalize_expr(want)
        )

    return cases.select(
        "case_id", "language", "group", "known_limitation", "has_overrides", "error",
        "expected_time", "expected_space", "answer_time", "answer_space",
        hit(F.col("answer_time"), F.col("expected_time")).alias("time_ok"),
        hit(F.col("answer_space"), F.col("expected_space")).alias("space_ok"),
        rank_error("time", time_classes).alias("time_rank_error"),
        rank_error("space", space_classes).alias("space_rank_error"),
        expr_ok("time").alias("time_expr_ok"),
        expr_ok("space").alias("space_expr_ok"),
    )


_SLICE_KEYS = ("language", "expected_time", "expected_space", "group")


def scorecard(results: DataFrame) -> DataFrame:
    """Slices over all gated rows and by language, class and group; limitations apart.

    One pass: grouping sets over the gated flag and the four slice columns.
    """
    gated = ~F.col("known_limitation")
    base = results.withColumn("gated", gated)
    sets = [["gated"], *[["gated", k] for k in _SLICE_KEYS]]
    mean = lambda c: F.avg(F.col(c).cast("double"))
    sliced = base.groupingSets(sets, "gated", *_SLICE_KEYS).agg(
        F.grouping_id().alias("g"),
        rows().alias("n"),
        mean("time_ok").alias("time_accuracy"),
        mean("space_ok").alias("space_accuracy"),
        F.avg("time_rank_error").alias("mean_time_rank_error"),
        F.avg("space_rank_error").alias("mean_space_rank_error"),
        F.avg(F.col("time_expr_ok").cast("double")).alias("time_expr_accuracy"),
        F.avg(F.col("space_expr_ok").cast("double")).alias("space_expr_accuracy"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    slice_name = (
        F.when((F.col("g") == 15) & F.col("gated"), "overall")
        .when(F.col("g") == 15, "known_limitations")
        .when(F.col("g") == 7, "language")
        .when(F.col("g") == 11, "time_class")
        .when(F.col("g") == 13, "space_class")
        .otherwise("group")
    )
    return sliced.filter(F.col("gated") | (F.col("g") == 15)).select(
        slice_name.alias("slice"),
        F.coalesce(*_SLICE_KEYS, F.lit("all")).alias("key"),
        "n", "time_accuracy", "space_accuracy", "mean_time_rank_error",
        "mean_space_rank_error", "time_expr_accuracy", "space_expr_accuracy", "errors",
    )


def failing_pairs(results: DataFrame) -> DataFrame:
    return results.filter(
        ~F.col("known_limitation") & ~(F.col("time_ok") & F.col("space_ok"))
    ).select("case_id", "language")


def cross_language_consistency(results: DataFrame) -> DataFrame:
    """Cases without overrides in at least two languages: same answer everywhere, all right.

    A pair with NULLs is a pair of its own, so answers are compared as structs.
    """
    pair = F.struct("answer_time", "answer_space")
    per_case = (
        results.filter(~F.col("known_limitation") & ~F.col("has_overrides"))
        .groupBy("case_id")
        .agg(
            rows().alias("languages"),
            F.bool_and(F.col("error").isNull()).alias("clean"),
            (F.min(pair) == F.max(pair)).alias("same"),
            F.bool_and(F.col("time_ok") & F.col("space_ok")).alias("right"),
        )
        .filter(F.col("languages") >= 2)
    )
    return per_case.agg(
        rows().alias("cases"),
        share(F.count_if(F.col("clean") & F.col("same")), rows()).alias("consistent"),
        share(F.count_if("right"), rows()).alias("correct"),
    )


def experiment_readout(results: DataFrame, baseline: str) -> DataFrame:
    """Best variant, its lead over the baseline, and the variant whose loss costs most.

    ``results`` has one row per variant: (name, macro_f1).
    """
    base = F.max(F.when(F.col("name") == baseline, F.col("macro_f1")))
    best = F.max(F.struct("macro_f1", "name"))
    worst = F.min(F.when(F.col("name") != baseline, F.struct("macro_f1", "name")))
    return results.agg(
        best["name"].alias("winner"),
        best["macro_f1"].alias("winner_macro_f1"),
        (best["macro_f1"] - base).alias("lead"),
        worst["name"].alias("costliest"),
        (base - worst["macro_f1"]).alias("drop"),
    )


def normalised_share(frame: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each value over the total of its group; all 0 when the total is not positive.

    The table is one row per feature, so the window holds a short fixed list.
    """
    total = F.sum(value).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return frame.withColumn(value, F.when(total > 0, F.col(value) / total).otherwise(0.0))
