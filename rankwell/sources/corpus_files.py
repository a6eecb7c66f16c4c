"""Reading and writing labelled corpora as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = (
    "problem_id", "solution_id", "source", "language", "code", "time_class", "space_class",
)
CORPUS = T.StructType(
    [T.StructField(name, T.StringType(), name in ("time_class", "space_class")) for name in FIELDS]
)
_MAP = "map<string,string>"


def _keys_of(raw: Column) -> Column:
    return F.coalesce(F.map_keys(raw), F.array().cast("array<string>"))


def _unfilled(raw: Column) -> Column:
    """Required fields that are missing or NULL."""
    required = F.array(*map(F.lit, FIELDS[:5]))
    return F.filter(required, lambda f: F.element_at(raw, f).isNull())


def _sound(raw: Column) -> Column:
    """Whether a parsed line has exactly the wanted keys and all required values.

    Keys are compared on the raw line, because a JSON reader with a schema fills
    missing keys and ignores unknown ones.
    """
    wanted = F.array_sort(F.array(*map(F.lit, FIELDS)))
    return (
        raw.isNotNull() & F.array_sort(_keys_of(raw)).eqNullSafe(wanted) & (F.size(_unfilled(raw)) == 0)
    )


def _checked(raw: Column, line: Column) -> Column:
    """The parsed line; one that is not a record fails the job when it is read."""
    refused = F.raise_error(F.concat(F.lit("not a corpus record: "), line)).cast(_MAP)
    return F.when(_sound(raw), raw).otherwise(refused)


def read_corpus(spark: SparkSession, path: str | list[str], validate: bool = True) -> DataFrame:
    """Corpus records of one or more files or folders; blank lines are skipped.

    With ``validate`` a line with an unknown, missing or malformed field fails
    the job when it is read.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    raw = F.from_json("value", _MAP)
    parsed = lines.select(
        (_checked(raw, F.col("value")) if validate else raw).alias("raw"),
        F.col("_metadata.file_name").alias("file_name"),
    )
    return parsed.select(*[F.col("raw")[f].alias(f) for f in FIELDS], "file_name")


def invalid_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines :func:`read_corpus` would refuse, with the reason.

    ``missing`` holds required fields without a value as well.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    wanted = F.array(*map(F.lit, FIELDS))
    parsed = lines.select("value", F.from_json("value", _MAP).alias("raw"))
    raw = F.col("raw")
    return parsed.filter(~_sound(raw)).select(
        "value",
        F.array_union(F.array_except(wanted, _keys_of(raw)), F.coalesce(_unfilled(raw), wanted)).alias("missing"),
        F.array_except(_keys_of(raw), wanted).alias("unknown"),
    )


def write_corpus(frame: DataFrame, path: str) -> None:
    """Replace ``path`` by the records; parent folders are created by the writer."""
    frame.select(*FIELDS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_corpora(
    spark: SparkSession, folder: str, pattern: str = "*.jsonl", validate: bool = True
) -> DataFrame:
    """Every corpus below ``folder`` except earlier split outputs.

    ``pattern`` names files or folders of part files.  The corpus name stays as
    ``file_name`` and orders the union.  With ``validate`` a line that is not a
    corpus record fails the job, as in :func:`read_corpus`.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.jsonl)(/[^/]*)?$", 1)
    lines = spark.read.text(f"{folder}/{pattern}").select("value", name.alias("file_name"))
    kept = lines.filter(~F.col("file_name").startswith("split_") & (F.trim("value") != ""))
    raw = F.from_json("value", _MAP)
    parsed = kept.select((_checked(raw, F.col("value")) if validate else raw).alias("raw"), "file_name")
    return parsed.select(*[F.col("raw")[f].alias(f) for f in FIELDS], "file_name")


def write_splits(frame: DataFrame, folder: str) -> None:
    """One sub-folder per split; rows go straight to their split's files."""
    frame.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(
        folder
    )


def write_once(frame: DataFrame, path: str, force: bool = False) -> None:
    """Write evidence that must not be replaced; ``force`` overwrites on purpose."""
    frame.write.mode("overwrite" if force else "errorifexists").parquet(path)
