"""Hand-checked cases: loading, per-language overrides, and every rule violation as a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.ordinal import SPACE_CLASSES, TIME_CLASSES

# Languages every case needs, allowed extra ones, the id pattern.
CORE_LANGUAGES = ("python", "cpp", "java", "javascript", "go")
ALL_LANGUAGES = (*CORE_LANGUAGES, "c")
ID_PATTERN = "^[a-z][a-z0-9_]*$"
OVERRIDABLE = ("time_class", "space_class", "time_expr", "space_expr")
KNOWN_LIMITATION = "known-limitation"

CASE_SCHEMA = (
    "id string, title string, group string, tags array<string>, time_class string, "
    "space_class string, time_expr string, space_expr string, rationale string, "
    "sources map<string,string>, overrides map<string,map<string,string>>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Nested cases, one JSON object per line, with the file they come from."""
    return spark.read.schema(CASE_SCHEMA).json(path).select(
        "*", F.col("_metadata.file_name").alias("file_name")
    )


def expected_by_language(cases: DataFrame) -> DataFrame:
    """One row per case and language with the override applied where there is one."""
    rows = cases.select("*", F.explode("sources").alias("language", "source"))
    override = F.element_at("overrides", F.col("language"))
    return rows.select(
        F.col("id").alias("case_id"),
        "group", "language", "source",
        *[
            F.coalesce(F.element_at(override, F.lit(field)), F.col(field)).alias(field)
            for field in OVERRIDABLE
        ],
        (F.coalesce(F.size("overrides"), F.lit(0)) > 0).alias("has_overrides"),
        F.coalesce(F.array_contains("tags", KNOWN_LIMITATION), F.lit(False)).alias(
            "known_limitation"
        ),
    )


def violations(
    cases: DataFrame,
    core: Sequence[str] = CORE_LANGUAGES,
    allowed: Sequence[str] = ALL_LANGUAGES,
    time_classes: Sequence[str] = TIME_CLASSES,
    space_classes: Sequence[str] = SPACE_CLASSES,
    id_pattern: str = ID_PATTERN,
) -> DataFrame:
    """(id, rule, detail) for everything wrong with a table of cases.

    All rules on one case are evaluated in one projection; only duplicate ids
    need a grouping, over the id column alone.
    """
    none = F.lit(None).cast("string")

    def rule(name: str, test: Column, detail: Column = none) -> Column:
        return F.when(
            F.coalesce(test, F.lit(False)),
            F.struct(F.lit(name).alias("rule"), detail.alias("detail")),
        )

    languages = F.map_keys("sources")
    listed = lambda names: F.array(*map(F.lit, names))
    missing = F.array_except(listed(core), languages)
    unknown = F.array_except(languages, listed(allowed))
    empty = F.map_keys(F.map_filter("sources", lambda _, v: F.trim(v) == ""))
    override_keys = F.coalesce(F.map_keys("overrides"), F.array().cast("array<string>"))
    stray = F.array_except(override_keys, languages)
    fields = F.array_distinct(
        F.flatten(F.transform(F.map_values("overrides"), lambda m: F.map_keys(m)))
    )
    bad_fields = F.array_except(fields, listed(OVERRIDABLE))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    expression = lambda c: ~(F.col(c).startswith("O(") & F.col(c).endswith(")"))
    override_class = lambda field, names: F.exists(
        F.map_values("overrides"), lambda m: ~m[field].isin(*names)
    )
    rules = [
        *[
            rule("missing_field", blank(c), F.lit(c))
            for c in ("id", "time_class", "space_class", "time_expr", "space_expr", "rationale")
        ],
        rule("bad_id", ~F.col("id").rlike(id_pattern)),
        rule("bad_class", ~F.col("time_class").isin(*time_classes), F.col("time_class")),
        rule("bad_class", ~F.col("space_class").isin(*space_classes), F.col("space_class")),
        rule("bad_expression", expression("time_expr"), F.col("time_expr")),
        rule("bad_expression", expression("space_expr"), F.col("space_expr")),
        rule("missing_language", F.size(missing) > 0, F.array_join(missing, ",")),
        rule("unknown_language", F.size(unknown) > 0, F.array_join(F.array_sort(unknown), ",")),
        rule("empty_source", F.size(empty) > 0, F.array_join(F.array_sort(empty), ",")),
        rule("stray_override", F.size(stray) > 0, F.array_join(F.array_sort(stray), ",")),
        rule("bad_override_field", F.size(bad_fields) > 0, F.array_join(F.array_sort(bad_fields), ",")),
        rule("bad_override_class", override_class("time_class", time_classes), F.lit("time_class")),
        rule("bad_override_class", override_class("space_class", space_classes), F.lit("space_class")),
        rule(
            "unexplained_override",
            (F.size(override_keys) > 0) & ~F.lower("rationale").rlike("override|differs"),
        ),
    ]
    found = cases.select("id", F.inline(F.array_compact(F.array(*rules))))
    duplicates = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "id", F.lit("duplicate_id").alias("rule"), F.col("n").cast("string").alias("detail")
    )
    return found.unionByName(duplicates)
