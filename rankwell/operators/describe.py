"""Describing a corpus: distributions, group sizes, near duplicates, leaks and floors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = "<none>"


def class_distribution(frame: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per class in both dimensions, in one pass over the input."""
    cells = F.array(
        F.struct(F.lit("time").alias("dimension"), F.coalesce("time_class", F.lit(NONE)).alias("class")),
        F.struct(F.lit("space").alias("dimension"), F.coalesce("space_class", F.lit(NONE)).alias("class")),
    )
    return (
        frame.select(*by, F.inline(cells))
        .groupBy(*by, "dimension", "class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def corpus_description(frame: DataFrame) -> DataFrame:
    """Long table (metric, key, value) of sizes, mixes and missing labels.

    One aggregation per grouping set over three narrow columns; distinct
    problems are counted by a second grouping instead of a wide distinct.
    """
    missing = lambda c: F.col(c).isNull()
    count = F.count(F.lit(1))
    sets = (
        frame.select("language", "source", F.coalesce("time_class", F.lit(NONE)).alias("label"),
                     missing("time_class").alias("no_time"), missing("space_class").alias("no_space"))
        .groupingSets(
            [[], ["language"], ["source"], ["language", "label"]], "language", "source", "label"
        )
        .agg(
            F.grouping_id().alias("g"),
            count.alias("records"),
            F.count_if("no_time").alias("time_label_missing"),
            F.count_if("no_space").alias("space_label_missing"),
            F.count_if(F.col("no_time") & F.col("no_space")).alias("no_usable_label"),
        )
    )
    cell = lambda m, k, v: F.struct(
        F.lit(m).alias("metric"), k.alias("key"), F.col(v).alias("value")
    )
    overall = F.array(
        *[
            cell(m, F.lit("all"), m)
            for m in ("records", "time_label_missing", "space_label_missing", "no_usable_label")
        ]
    )
    cells = (
        F.when(F.col("g") == 7, overall)
        .when(F.col("g") == 3, F.array(cell("languages", F.col("language"), "records")))
        .when(F.col("g") == 5, F.array(cell("sources", F.col("source"), "records")))
        .otherwise(
            F.array(
                cell("time_labels_by_language", F.concat_ws("/", "language", "label"), "records")
            )
        )
    )
    problems = frame.select("source", "problem_id").distinct().agg(count.alias("value")).select(
        F.lit("problems").alias("metric"), F.lit("all").alias("key"), "value"
    )
    return sets.select(F.inline(cells)).unionByName(problems)


def group_size_profile(frame: DataFrame, keys: list[str], over: int = 50) -> DataFrame:
    """Largest group, upper median, p95 by index, and groups above ``over``.

    Sizes are counted first.  The number of different sizes is at most the
    square root of twice the row count, which bounds the one-partition window.
    """
    sizes = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    counted = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    upto = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("size").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    placed = counted.select(
        "size", "groups",
        F.sum("groups").over(upto).alias("upto"),
        F.sum("groups").over(whole).alias("total"),
    )
    first_above = lambda index: F.min(F.when(F.col("upto") > index, F.col("size")))
    return placed.agg(
        F.coalesce(F.max("size"), F.lit(0)).alias("max"),
        F.coalesce(first_above(F.floor(F.col("total") / 2)), F.lit(0)).alias("median"),
        F.coalesce(first_above(F.floor(F.col("total") * 0.95)), F.lit(0)).alias("p95"),
        F.coalesce(F.sum(F.when(F.col("size") > over, F.col("groups"))), F.lit(0)).alias(
            "groups_over"
        ),
    )


def near_duplicates(sample: DataFrame, signature: str = "signature") -> DataFrame:
    """Share of sampled rows that repeat another of the same problem, shape and labels."""
    keys = ["source", "problem_id", signature, "time_class", "space_class"]
    groups = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    parsed = F.col(signature).isNotNull()
    redundant = F.coalesce(F.sum(F.when(parsed, F.col("size") - 1)), F.lit(0))
    unparsed = F.coalesce(F.sum(F.when(~parsed, F.col("size"))), F.lit(0))
    sampled = F.coalesce(F.sum("size"), F.lit(0))
    return groups.agg(
        sampled.alias("sampled"),
        unparsed.alias("unparsed"),
        redundant.alias("redundant_in_sample"),
        F.round(redundant / F.greatest(F.lit(1), sampled - unparsed), 4).alias("redundant_share"),
    )


def parse_statistics(frame: DataFrame, status: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals per parse status; a status outside parsed/unsupported names a failure type."""
    return (
        frame.withColumn("status", status)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status") == "parsed").alias("parsed"),
            F.count_if(F.col("status") == "unsupported").alias("unsupported_language"),
            F.count_if(~F.col("status").isin("parsed", "unsupported")).alias("failed"),
        )
    )


def failure_types(frame: DataFrame, status: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return (
        frame.withColumn("failure", status)
        .filter(~F.col("failure").isin("parsed", "unsupported"))
        .groupBy(*by, "failure")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def split_leaks(frame: DataFrame) -> DataFrame:
    """Problems found in more than one split; empty when the split is sound."""
    return (
        frame.groupBy("source", "problem_id")
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def below_floor(frame: DataFrame, key: str, floors: Mapping[str, int]) -> DataFrame:
    """Keys with fewer rows than their floor, absent keys included."""
    need = frame.sparkSession.createDataFrame(list(floors.items()), f"{key} string, need long")
    have = frame.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    return (
        need.join(have, key, "left")
        .select(key, F.coalesce("have", F.lit(0)).alias("have"), "need")
        .filter(F.col("have") < F.col("need"))
    )


def split_report(frame: DataFrame) -> DataFrame:
    """Records, problems and label counts per split as (split, metric, class, n)."""
    totals = frame.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(
        "split", F.lit("records").alias("metric"), F.lit("all").alias("class"), "n"
    )
    problems = (
        frame.select("split", "source", "problem_id").distinct()
        .groupBy("split").agg(F.count(F.lit(1)).alias("n"))
        .select("split", F.lit("problems").alias("metric"), F.lit("all").alias("class"), "n")
    )
    labels = class_distribution(frame, ("split",)).select(
        "split", F.concat("dimension", F.lit("_class")).alias("metric"), "class", "n"
    )
    return totals.unionByName(problems).unionByName(labels)
