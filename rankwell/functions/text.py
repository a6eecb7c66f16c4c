"""Text helpers: languages by file extension, call names, request checks, log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.functions.ordinal import literal_map

# File extensions, served languages and the size limit in bytes.
LANGUAGE_OF_EXTENSION = {
    ".py": "python", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp",
    ".java": "java", ".js": "javascript", ".mjs": "javascript", ".c": "c", ".go": "go",
    ".ts": "typescript", ".rs": "rust", ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin",
}
SERVED_LANGUAGES = ("python", "cpp", "java", "javascript", "c", "go")
MAX_CODE_BYTES = 65_536


def extension(path: Column) -> Column:
    """Last suffix of the last path part, lower case; empty when there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language_of_path(path: Column, table: dict[str, str] = LANGUAGE_OF_EXTENSION) -> Column:
    """Language by extension, NULL for an unknown one."""
    return F.element_at(literal_map(table), extension(path))


def language_of_path_strict(path: Column, table: dict[str, str] = LANGUAGE_OF_EXTENSION) -> Column:
    found = language_of_path(path, table)
    return F.when(
        found.isNull(),
        F.raise_error(F.concat(F.lit("no known language for extension "), extension(path))),
    ).otherwise(found)


def trailing_segment(name: Column) -> Column:
    """The part of a qualified name after its last dot or arrow."""
    return F.element_at(F.split(F.replace(name, F.lit("->"), F.lit(".")), r"\."), -1)


def reject_reason(
    code: Column,
    language: Column,
    served: Sequence[str] = SERVED_LANGUAGES,
    max_bytes: int = MAX_CODE_BYTES,
) -> Column:
    """Why a request is refused, NULL when it is not.  Size counts bytes, not characters."""
    return F.when(
        F.octet_length(code) > max_bytes, F.lit(f"code exceeds the {max_bytes}-byte cap")
    ).when(
        (language != "auto") & ~language.isin(*served),
        F.format_string("unsupported language: '%s'", language),
    )


def first_rule(
    name: Column,
    arguments: Column,
    arity_rules: Sequence[tuple[str, dict[str, str]]],
    rules: Sequence[tuple[str, str]],
    default: str = "CALL",
) -> Column:
    """Symbol of the first matching rule, rules on the argument count first.

    An empty symbol means the row is to be dropped and comes back NULL.  The
    rules are a short list written by hand, so they fold into one CASE ladder.
    """
    ladder = None
    for pattern, branches in arity_rules:
        symbol = F.when(arguments <= 1, F.lit(branches.get("one", ""))).otherwise(
            F.lit(branches.get("many", ""))
        )
        test = name.rlike(pattern)
        ladder = F.when(test, symbol) if ladder is None else ladder.when(test, symbol)
    for pattern, symbol in rules:
        test = name.rlike(pattern)
        ladder = F.when(test, symbol) if ladder is None else ladder.when(test, symbol)
    found = F.lit(default) if ladder is None else ladder.otherwise(default)
    return F.nullif(found, F.lit(""))


def event_line(event: str | Column, fields: DataFrame | Sequence[str]) -> Column:
    """One JSON object per row: the event name, then the named columns."""
    name = F.lit(event) if isinstance(event, str) else event
    return F.to_json(F.struct(name.alias("event"), *fields), {"ignoreNullFields": "false"})
