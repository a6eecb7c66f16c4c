"""Exact dedup by content-defined chunk recipes.

A text (white space deleted) is cut where a rolling hash of its last 32 bytes has
zeros, so equal texts are cut alike.  Chunks are deduplicated to identifiers of
eight bytes, and the distinct contents are moved once to verify that no two of
them share one; if two do, longer identifiers are taken and verified in turn.
Then only the ordered identifier lists (recipes) are compared, so a long document
moves as a few numbers however many copies it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import slim

#: Mean chunk: 2^BITS bytes.  No chunk is longer than LONGEST.
BITS = 11
LONGEST = 1 << 16
#: Bytes of an identifier: the first width that passes the check is used.
WIDTHS = (8, 16, 32)
_SPACE = bytes([0x20, 9, 10, 11, 12, 13])
#: Any fixed table of random words serves; this one comes from a seed.
_GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(body: bytes, bits: int = BITS, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of ``body``, in order; none for an empty body."""
    if not body:
        return []
    h = _GEAR[np.frombuffer(body, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # doubles the window: 2, 4, ... 32 bytes
        h[step:] += h[:-step] << np.uint32(step)
    ends: list[int] = []
    start = 0
    for end in [*(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist(), len(body)]:
        while end - start > longest:
            start += longest
            ends.append(start)
        if end > start:
            ends.append(end)
            start = end
    return ends


def _chunks(body: bytes) -> Iterator[bytes]:
    start = 0
    for end in cut_points(body):
        yield body[start:end]
        start = end


def _identifier(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACE)


_RECIPES = "doc_id bigint, n_chars bigint, recipe binary, text_sha256 string"
_CONTENTS = "identifier binary, content binary"


def _recipes(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        bodies = [_normal(t) for t in texts]
        lists = [b"".join(_identifier(c, width) for c in _chunks(b)) for b in bodies]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(t or "") for t in texts], pa.int64()),
                pa.array(lists, pa.binary()),
                pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
            ],
            names=["doc_id", "n_chars", "recipe", "text_sha256"],
        )


def _contents(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list({c for t in batch.column("text").to_pylist() for c in _chunks(_normal(t))})
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_identifier(c, width) for c in rows], pa.binary()),
                pa.array(rows, pa.binary()),
            ],
            names=["identifier", "content"],
        )


def verified_width(rows: DataFrame, widths: Sequence[int] = WIDTHS) -> int:
    """The first width at which every identifier of the table stands for one content."""
    for width in widths:
        distinct = rows.select("text").mapInArrow(partial(_contents, width), _CONTENTS).distinct()
        contents = distinct.groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))
        if contents.filter("n > 1").isEmpty():
            return width
    raise ValueError(f"two chunks share an identifier of {widths[-1]} bytes")


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    widths: Sequence[int] = WIDTHS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the white space of the
    contract.  The row with the most code points, then the smallest id, stays.
    NULL counts as the empty text; empty texts form one group.  NULL ids come after
    all others.  Repeated rows count one by one in ``group_size`` and are all
    ``kept`` if they carry the id that stays.  Other columns are not read.
    """
    rows = slim(docs, doc_id=doc_id, text=text)
    recipes = rows.mapInArrow(partial(_recipes, verified_width(rows, widths)), _RECIPES)
    groups = recipes.groupBy("recipe").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("n_chars", (-F.col("doc_id")).alias("back"))).alias("best"),
    ).select(F.col("recipe").alias("key"), "group_size", (-F.col("best.back")).alias("keep_id"))
    # one recipe may belong to a third of all rows: the join can split it, a window could not
    return recipes.join(groups, F.col("recipe") == F.col("key")).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
