"""Fitting growth shapes to measured costs, and projecting cost terms on classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions.growth import (
    SPACE_SHAPES,
    TIME_SHAPES,
    curve_value,
    log_basis,
    size_grid,
)
from rankwell.functions.ordinal import class_array, literal_map, rank_of
from rankwell.functions.skew import value_at_ranks

R2_FLOOR = 0.8
RSS_FLOOR = 1e-12


def valid_sizes(frame: DataFrame, size: str = "n", smallest: int = 2) -> DataFrame:
    return frame.filter(F.col(size) >= smallest)


def median_costs(samples: DataFrame, costs: Sequence[str], series: str = "series") -> DataFrame:
    """(series, cost, n, median): the averaged median of every cost at every size.

    Measurements are counted by value first, so a size measured a billion times
    is as cheap as one measured twice.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("cost"), F.col(c).alias("value")) for c in costs]
    )
    long = samples.select(series, "n", F.inline(cells)).filter(F.col("value").isNotNull())
    n = F.col("_n")
    picked = value_at_ranks(
        long.withColumnRenamed("n", "size"), [series, "cost", "size"], "value",
        [("low", F.floor((n + 1) / 2)), ("high", F.floor(n / 2) + 1)],
    )
    return picked.select(
        series, "cost", F.col("size").alias("n"),
        ((F.col("low") + F.col("high")) / 2).alias("median"),
    )


def fit_shapes(
    medians: DataFrame,
    shapes_of_cost: Mapping[str, Sequence[str]],
    series: str = "series",
    strict: bool = False,
) -> DataFrame:
    """One row per (series, cost, shape): log scale, R^2, BIC, rank and BIC weight.

    ``medians`` is small (one row per size); each row meets the shapes of its
    cost.  Fewer than two sizes cannot be fitted: such series are left out, or
    fail the job when ``strict``.
    """
    position = {shape: i for i, shape in enumerate(TIME_SHAPES)}

    def candidates(names: Sequence[str]) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(s).alias("shape"), F.lit(position[s]).alias("position"),
                    log_basis(s, F.col("n")).alias("basis"),
                )
                for s in names
            ]
        )

    offered = None
    for cost, names in shapes_of_cost.items():
        test = F.col("cost") == cost
        offered = F.when(test, candidates(names)) if offered is None else offered.when(
            test, candidates(names)
        )
    log_cost = F.ln(F.greatest(F.col("median"), F.lit(1.0)))
    rows = medians.withColumn("log_cost", log_cost).select(
        series, "cost", "n", "log_cost", F.inline(offered)
    )
    residual = F.col("log_cost") - F.col("basis")
    sums = rows.groupBy(series, "cost", "shape", "position").agg(
        F.count(F.lit(1)).alias("m"),
        F.avg(residual).alias("log_scale"),
        (F.var_pop(residual) * F.count(F.lit(1))).alias("rss"),
        (F.var_pop("log_cost") * F.count(F.lit(1))).alias("tss"),
    )
    if strict:
        sums = sums.withColumn(
            "m",
            F.when(
                F.col("m") < 2,
                F.raise_error(F.concat(F.lit("fewer than two sizes in series "), F.col(series))),
            ).otherwise(F.col("m")),
        )
    fitted = sums.filter(F.col("m") >= 2).select(
        series, "cost", "shape", "position", "log_scale",
        F.when(F.col("rss") == 0, 1.0)
        .when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss"))
        .otherwise(0.0)
        .alias("r_squared"),
        (F.col("m") * F.ln(F.greatest(F.col("rss"), F.lit(RSS_FLOOR)) / F.col("m")) + F.ln("m")).alias(
            "bic"
        ),
    )
    # at most seven rows per series and cost
    group = Window.partitionBy(series, "cost")
    weight = F.exp(-0.5 * (F.col("bic") - F.min("bic").over(group)))
    return (
        fitted.withColumn("rank", F.row_number().over(group.orderBy("bic", "position")))
        .withColumn("weight", weight)
        .withColumn("weight", F.col("weight") / F.sum("weight").over(group))
        .drop("position")
    )


def insufficient_series(medians: DataFrame, series: str = "series") -> DataFrame:
    """Series with fewer than two sizes, which no shape can be fitted to."""
    return (
        medians.groupBy(series, "cost").agg(F.count(F.lit(1)).alias("sizes")).filter("sizes < 2")
    )


def best_fits(fits: DataFrame, series: str = "series") -> DataFrame:
    """Best shape, its confidence and the runner-up of every series and cost."""
    pick = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    return fits.groupBy(series, "cost").agg(
        pick(1, "shape").alias("best"),
        pick(1, "r_squared").alias("r_squared"),
        pick(1, "weight").alias("confidence"),
        pick(2, "shape").alias("runner_up"),
    )


def classify_growth(
    best: DataFrame,
    time_cost: str,
    space_costs: Sequence[str],
    series: str = "series",
    floor: float = R2_FLOOR,
) -> DataFrame:
    """Time class, and the larger-ranked space class of the given signals.

    A fit below the R^2 floor gives no class.
    """
    good = F.col("r_squared") >= floor
    time = good & (F.col("cost") == time_cost)
    space = good & F.col("cost").isin(*space_costs)
    time_class = F.element_at(literal_map(TIME_SHAPES), F.col("best"))
    space_class = F.element_at(literal_map(SPACE_SHAPES), F.col("best"))
    # larger rank wins; on equal rank the signal named first
    names = F.array(*map(F.lit, space_costs))
    order = F.struct(
        rank_of(space_class, list(SPACE_SHAPES.values())),
        -F.array_position(names, F.col("cost")),
    )
    return best.groupBy(series).agg(
        F.max(F.when(time, time_class)).alias("time_class"),
        F.max(F.when(time, F.col("confidence"))).alias("time_confidence"),
        F.max_by(F.when(space, space_class), F.when(space, order)).alias("space_class"),
        F.max_by(F.when(space, F.col("confidence")), F.when(space, order)).alias(
            "space_confidence"
        ),
    )


def growth_curves(predicted: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Curve points of each predicted class and of its neighbours in rank.

    Adds ``series_class``, ``n`` and ``value``; 12 sizes for at most 3 classes.
    """
    names = class_array(classes)
    place = F.array_position(names, F.col(label))
    neighbours = F.filter(
        F.transform(F.array(place, place - 1, place + 1), lambda p: F.get(names, p.cast("int") - 1)),
        lambda c: c.isNotNull(),
    )
    grid = F.array(*map(F.lit, size_grid()))
    return (
        predicted.withColumn("series_class", F.explode(neighbours))
        .withColumn("n", F.explode(grid))
        .withColumn("value", curve_value(F.col("series_class"), F.col("n")))
    )


# ------------------------------------------------------------------- cost terms
def dominant_terms(terms: DataFrame, expression: str, term: str) -> DataFrame:
    """The dominant term of every expression with all variables taken as one.

    ``terms`` has a row per variable of a term: coef, power, log, base, is_fact.
    Two groupings with map-side combine; a term is one row after the first.
    """
    grows = (F.col("power") != 0) | (F.col("log") != 0)
    fast = (F.col("base") > 0) | F.col("is_fact")
    collapsed = (
        terms.filter(F.col("coef") > 0)
        .groupBy(expression, term)
        .agg(
            F.count_if("is_fact").alias("facts"),
            F.max("base").alias("base"),
            F.sum("power").alias("power"),
            F.sum("log").alias("log"),
            (F.bool_or(grows) & F.bool_or(fast)).alias("extras"),
        )
    )
    return collapsed.groupBy(expression).agg(
        F.max(F.struct("facts", "base", "power", "log", "extras")).alias("t")
    ).select(expression, "t.*")


#: Classes of a scale, smallest first: name, then kind (0 polynomial, 1 exponential,
#: 2 factorial) and size within it: (power, log), (base, 0) or (factorials, 0).
Scale = Sequence[tuple[str, int, float, float]]

TIME_SCALE: Scale = (
    ("O(1)", 0, 0.0, 0.0),
    ("O(log n)", 0, 0.0, 1.0),
    ("O(n)", 0, 1.0, 0.0),
    ("O(n log n)", 0, 1.0, 1.0),
    ("O(n^2)", 0, 2.0, 0.0),
    ("O(n^3)", 0, 3.0, 0.0),
    ("O(2^n)", 1, 2.0, 0.0),
)
SPACE_SCALE: Scale = TIME_SCALE[:5]
#: Classes of the extended list that a term takes only where they fit exactly.
EXACT_SCALE: Scale = (("O(sqrt n)", 0, 0.5, 0.0), ("O(n^2 log n)", 0, 2.0, 1.0))
FACTORIAL_SCALE: Scale = (("O(n!)", 2, 1.0, 0.0),)


def _term_size() -> tuple[Column, Column, Column]:
    """Kind, first and second size of a dominant term, comparable with the classes."""
    facts, base = F.col("facts").cast("double"), F.col("base").cast("double")
    power, log = F.col("power").cast("double"), F.col("log").cast("double")
    kind = F.when(facts > 0, 2).when(base > 0, 1).otherwise(0)
    lead = F.when(facts > 0, facts).when(base > 0, base).otherwise(power)
    return kind, lead, F.when(kind == 0, log).otherwise(0.0)


def _on_scale(scale: Scale) -> Column:
    """struct<class, lossy>: the first class of the term's kind that is not below it.

    Above all classes of its kind a term takes the last of them; a kind the scale does
    not know takes its last class.  Lossy if the class is not of the term's size, or the
    term holds factors beside its dominant one.  Plain comparisons, class by class.
    """
    kind, lead, second = _term_size()

    def answer(name: str, lossy: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), (lossy | F.col("extras")).alias("lossy"))

    found = None
    last = {k: name for name, k, _, _ in scale}
    for name, k, a, b in scale:
        same = (lead == a) & (second == b)
        fits = (kind == k) & ((lead < a) | ((lead == a) & (second <= b)))
        found = F.when(fits, answer(name, ~same)) if found is None else found.when(fits, answer(name, ~same))
    for k, name in last.items():
        found = found.when(kind == k, answer(name, F.lit(True)))
    return found.otherwise(answer(scale[-1][0], F.lit(True)))


def project_time() -> Column:
    return _on_scale(TIME_SCALE)


def project_time_extended() -> Column:
    """As :func:`project_time`, with the classes that only the extended list has."""
    exact = _on_scale(EXACT_SCALE)
    return (
        F.when(F.col("facts") > 0, _on_scale(FACTORIAL_SCALE))
        .when((F.col("base") <= 0) & ~exact["lossy"], exact)
        .otherwise(project_time())
    )


def project_space() -> Column:
    return _on_scale(SPACE_SCALE)


def project_terms(
    expressions: DataFrame, terms: DataFrame, expression: str, term: str
) -> DataFrame:
    """Classes of every expression; one without terms is constant."""
    dominant = dominant_terms(terms, expression, term)
    filled = expressions.join(dominant, expression, "left").select(
        expression,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("facts", "base", "power", "log")],
        F.coalesce("extras", F.lit(False)).alias("extras"),
    )
    return filled.select(
        expression,
        project_time().alias("t"), project_time_extended().alias("x"), project_space().alias("s"),
    ).select(
        expression,
        F.col("t.class").alias("time_class"), F.col("t.lossy").alias("time_lossy"),
        F.col("x.class").alias("extended_class"), F.col("x.lossy").alias("extended_lossy"),
        F.col("s.class").alias("space_class"), F.col("s.lossy").alias("space_lossy"),
    )
