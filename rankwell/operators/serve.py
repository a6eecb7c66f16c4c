"""What surrounds an answer: certainty, derivation steps, attributions, library costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.functions.ordinal import literal_map
from rankwell.functions.skew import keep_lowest

# Order of step kinds on one line, and how salient each kind is.
KIND_ORDER = {"loop": 0, "recursion": 1, "call": 2, "alloc": 3}
SALIENCE = {"loop": 1.0, "recursion": 1.0, "call": 0.5, "alloc": 0.4}
MAX_STEPS = 8
TOP_FEATURES = 5
SMALLEST_CONTRIBUTION = 1e-9


def certainty_rollup(programs: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Any unknown note makes a program unknown, else any assumed one makes it assumed."""
    flags = notes.groupBy(key).agg(
        F.bool_or(F.col("kind") == "unknown").alias("unknown"),
        F.count_if(F.col("kind") == "assumed").alias("assumptions"),
    )
    return programs.join(flags, key, "left").select(
        key,
        F.when(F.col("unknown"), "unknown")
        .when(F.col("assumptions") > 0, "assumed")
        .otherwise("certain")
        .alias("certainty"),
        F.coalesce("assumptions", F.lit(0)).alias("assumptions"),
    )


def assumptions(notes: DataFrame, key: str) -> DataFrame:
    return notes.filter(F.col("kind") == "assumed").select(key, "line", "reason")


def latest_steps(
    steps: DataFrame, program: str, sequence: Column, kinds: Mapping[str, int] = KIND_ORDER
) -> DataFrame:
    """The last record of every (kind, line, key) of a program, with its sort position."""
    rank = F.coalesce(F.element_at(literal_map(kinds), F.col("kind")), F.lit(9))
    return (
        steps.groupBy(program, "kind", "line", "key")
        .agg(F.max_by("text", sequence).alias("text"))
        .withColumn("kind_rank", rank)
    )


def salient_steps(
    steps: DataFrame,
    program: str,
    sequence: str,
    salience: Mapping[str, float] = SALIENCE,
    most: int = MAX_STEPS,
) -> DataFrame:
    """The most salient steps of a program, in source order within one salience.

    Steps of other kinds, beyond the last line or on a blank line are dropped.
    """
    weighted = steps.withColumn("salience", F.element_at(literal_map(salience), F.col("kind")))
    sound = (
        F.col("salience").isNotNull()
        & F.col("line").between(1, F.col("line_count"))
        & (F.trim("line_text") != "")
    )
    return keep_lowest(
        weighted.filter(sound), [program], [-F.col("salience"), F.col(sequence)], most
    )


def top_contributions(
    frame: DataFrame,
    features: Sequence[str],
    weights: Column,
    scales: Column,
    most: int = TOP_FEATURES,
) -> Column:
    """Ranked array<struct<feature, contribution>>: weight x value / scale.

    ``weights`` and ``scales`` are maps by feature with defaults 0 and 1.  All of
    a row's features are on the row, so ranking needs no shuffle.
    """
    cells = []
    for place, name in enumerate(features):
        weight = F.coalesce(F.element_at(weights, F.lit(name)), F.lit(0.0))
        scale = F.coalesce(F.element_at(scales, F.lit(name)), F.lit(1.0))
        value = weight * (F.col(name) / scale)
        cells.append(
            F.struct(
                (-F.abs(value)).alias("order"), F.lit(place).alias("place"),
                F.lit(name).alias("feature"), F.round(value, 6).alias("contribution"),
            )
        )
    kept = F.filter(F.array(*cells), lambda c: c["order"] <= -SMALLEST_CONTRIBUTION)
    return F.transform(
        F.slice(F.array_sort(kept), 1, most),
        lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("contribution")),
    )


def library_costs(
    calls: DataFrame, costs: Mapping[tuple[str, str, str], tuple[str, str]]
) -> DataFrame:
    """Cost and allocation class of each (language, call, receiver) call.

    A call not in the hand-written table costs O(1) and is flagged assumed.
    """
    table = calls.sparkSession.createDataFrame(
        [(*key, *value) for key, value in costs.items()],
        "language string, call string, receiver string, cost string, allocation string",
    )
    joined = calls.join(F.broadcast(table), ["language", "call", "receiver"], "left")
    return joined.withColumns(
        {
            "assumed": F.col("cost").isNull(),
            "cost": F.coalesce("cost", F.lit("O(1)")),
            "allocation": F.coalesce("allocation", F.lit("O(1)")),
        }
    )


def feature_scales(frame: DataFrame, features: Sequence[str], floor: float = 0.5) -> DataFrame:
    """One row per feature: the population deviation, never below ``floor``."""
    row = frame.agg(
        *[F.greatest(F.stddev_pop(f), F.lit(floor)).alias(f) for f in features]
    )
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("scale")) for f in features])
    return row.select(F.inline(cells))
