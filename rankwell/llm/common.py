"""Column expressions and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: the space and the bytes 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shingle and the share of a near duplicate, unless a contract differs.
SHINGLE_WORDS = 5
SIMILARITY = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under own names, so that no other column can clash."""
    return frame.select(*[frame[old].alias(new) for new, old in columns.items()])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int = 3) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from all fits (NULL ids are)."""
    return F.coalesce(remainder(doc_id) == 1, F.lit(True))


def _passing(
    test: Callable[[list[str | None]], list[bool]], text: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield part.filter(pa.array(test(part.column(text).to_pylist()), pa.bool_()))


def rows_passing(
    docs: DataFrame, test: Callable[[list[str | None]], list[bool]], text: str = "text"
) -> DataFrame:
    """The rows whose text passes; no shuffle, and all columns whatever their names."""
    return docs.mapInArrow(partial(_passing, test, docs.columns.index(text)), docs.schema)
