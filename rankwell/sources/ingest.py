"""Ingest: nested, flat and catalogue sources into corpus records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.functions.ordinal import SPACE_LABELS, TIME_LABELS
from rankwell.operators.curate import map_labels


def explode_solutions(nested: DataFrame, position: str = "input_pos") -> DataFrame:
    """(problem_id, solution_id, code) of an array of solutions; a later duplicate wins.

    ``max_by`` is combined on the map side, so repeated keys never meet in bulk.
    """
    flat = nested.select(
        "problem_id", position, F.posexplode("correct_solution_list").alias("place", "s")
    )
    return flat.groupBy("problem_id", F.col("s.solution_id").alias("solution_id")).agg(
        F.max_by("s.solution_code", F.struct(position, "place")).alias("code")
    )


def join_labels(
    labels: DataFrame,
    code: DataFrame,
    source: str,
    language: str,
    time_labels: Mapping[str, Mapping[str, str]] = TIME_LABELS,
    space_labels: Mapping[str, Mapping[str, str]] = SPACE_LABELS,
) -> DataFrame:
    """Label rows with their code, mapped classes and an ``outcome``.

    ``outcome`` is kept, missing_code or dropped_no_usable_label; a row lives
    when at least one dimension is usable.
    """
    joined = labels.join(code, ["problem_id", "solution_id"], "left")
    mapped = map_labels(
        joined, "time_complexity_inferred", F.lit(source), time_labels, "time_class"
    )
    mapped = map_labels(
        mapped, "space_complexity_inferred", F.lit(source), space_labels, "space_class"
    )
    outcome = (
        F.when(F.col("code").isNull(), "missing_code")
        .when(F.col("time_class").isNull() & F.col("space_class").isNull(),
              "dropped_no_usable_label")
        .otherwise("kept")
    )
    return mapped.select(
        "problem_id", "solution_id",
        F.lit(source).alias("source"), F.lit(language).alias("language"), "code",
        "time_class", "space_class", "time_class_status", "space_class_status",
        outcome.alias("outcome"),
    )


def ingest_counters(joined: DataFrame) -> DataFrame:
    """Counts of every outcome, in one pass; label counters skip rows without code."""
    found = F.col("outcome") != "missing_code"
    measures = {
        "kept": F.col("outcome") == "kept",
        "missing_code": ~found,
        "dropped_no_usable_label": F.col("outcome") == "dropped_no_usable_label",
        "time_null": found & (F.col("time_class_status") == "null"),
        "time_unmapped": found & F.col("time_class_status").isin("unmapped", "unknown_source"),
        "space_null": found & (F.col("space_class_status") == "null"),
        "space_unmapped": found & F.col("space_class_status").isin("unmapped", "unknown_source"),
    }
    return joined.agg(*[F.count_if(test).alias(name) for name, test in measures.items()])


def flat_records(
    rows: DataFrame,
    source: str,
    language: str,
    row_index: str = "row_index",
    time_labels: Mapping[str, Mapping[str, str]] = TIME_LABELS,
) -> DataFrame:
    """Records of a flat source with ids ``{problem}_{language}_{row index}``.

    The index counts dropped rows too.  ``time_class_status`` tells what mapped.
    """
    mapped = map_labels(rows, "complexity", F.lit(source), time_labels, "time_class")
    return mapped.select(
        F.col("problem").alias("problem_id"),
        F.concat_ws("_", "problem", F.lit(language), F.col(row_index)).alias("solution_id"),
        F.lit(source).alias("source"),
        F.lit(language).alias("language"),
        F.col("src").alias("code"),
        "time_class",
        F.lit(None).cast("string").alias("space_class"),
        "time_class_status",
    )


def manifest_paths(manifest: DataFrame) -> DataFrame:
    """One row per (item, language, path) of a curated manifest."""
    return manifest.select(
        "name", "time_class", "space_class", F.explode("path_by_language").alias("language", "path")
    )


def manifest_records(wanted: DataFrame, files: DataFrame, source: str) -> DataFrame:
    """Manifest entries with their file content, ``code`` NULL where there is no file."""
    return wanted.join(files, "path", "left").select(
        F.col("name").alias("problem_id"),
        F.concat_ws("_", "name", "language").alias("solution_id"),
        F.lit(source).alias("source"),
        "language", "code", "time_class", "space_class", "path",
    )


def catalogue_records(catalogue: DataFrame, source: str) -> DataFrame:
    """One record per language of every catalogue row, sharing a problem id."""
    problem = F.concat_ws("_", F.lit(source), "name")
    return catalogue.select(
        problem.alias("problem_id"), "time_class", "space_class",
        F.explode("code_by_language").alias("language", "code"),
    ).select(
        "problem_id",
        F.concat_ws("_", "problem_id", "language").alias("solution_id"),
        F.lit(source).alias("source"),
        "language", "code", "time_class", "space_class",
    )
