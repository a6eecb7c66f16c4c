"""The calibration lookup: counts per certainty level and dimension, checked on load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.stats import laplace
from rankwell.operators.judge import SERVED_LEVELS

SCHEMA = "source string, levels map<string,map<string,struct<correct:bigint,total:bigint>>>"


def write_calibration(levels: DataFrame, path: str, source: str) -> None:
    """Write (certainty, dimension, correct, total) as one JSON document.

    The table has one row per level and dimension, a short fixed list.
    """
    cell = F.struct("correct", "total")
    per_level = levels.groupBy("certainty").agg(
        F.map_from_entries(F.collect_list(F.struct("dimension", cell))).alias("cells")
    )
    per_level.agg(
        F.map_from_entries(F.collect_list(F.struct("certainty", "cells"))).alias("levels")
    ).select(F.lit(source).alias("source"), "levels").coalesce(1).write.mode("overwrite").json(path)


def read_calibration(
    spark: SparkSession,
    path: str,
    levels: Sequence[str] = SERVED_LEVELS,
    dimensions: Sequence[str] = ("time", "space"),
) -> DataFrame:
    """(certainty, dimension, correct, total, confidence); a missing level or a bad count fails."""
    payload = spark.read.schema(SCHEMA).json(path)
    cells = F.array(
        *[
            F.struct(
                F.lit(level).alias("certainty"),
                F.lit(d).alias("dimension"),
                F.col("levels")[level].isNotNull().alias("known"),
                F.col("levels")[level][d].alias("cell"),
            )
            for level in levels
            for d in dimensions
        ]
    )
    rows = payload.select(F.inline(cells)).select(
        "certainty", "dimension", "known", "cell.correct", "cell.total"
    )
    return rows.select(
        "certainty",
        "dimension",
        _checked("correct").alias("correct"),
        F.col("total"),
        laplace(F.col("correct"), F.col("total")).alias("confidence"),
    )


def _checked(column: str) -> Column:
    sound = F.coalesce((F.col("correct") >= 0) & (F.col("correct") <= F.col("total")), F.lit(False))
    where = F.concat_ws("/", "certainty", "dimension")
    return (
        F.when(~F.col("known"), F.raise_error(F.concat(F.lit("calibration misses level "), where)))
        .when(~sound, F.raise_error(F.concat(F.lit("malformed counts for "), where)))
        .otherwise(F.col(column))
    )
