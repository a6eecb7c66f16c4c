"""Best-fit packing of token sequences by exact-complement hashing.

How many pieces there are of each length decides the whole packing, and there are
at most as many lengths as a sequence has tokens.  So the plan is made on that
table of counts, of a fixed size: for each length, the single lengths, pairs and
triples that exactly fill the rest are looked up in an index of sums and consumed
as often as all their counts allow; what is left goes best-fit, longest first.
Spark then numbers the pieces of each length and looks their place up in the plan.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.bpe import _WHITE, MEMO, unit_pattern
from rankwell.llm.common import slim
from rankwell.session import written

CAPACITY = 2048
#: Pieces of one length that are numbered together, about.
BLOCK_ROWS = 1 << 17
#: Documents tokenized at once.
PART = 1000

Run = tuple[int, int, int, int, int]


class _Plan:
    def __init__(self, counts: Mapping[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self.there = self.count > 0
        #: Number of ordered pairs of lengths at hand with each sum.
        self.pairs = np.convolve(self.there.astype(np.int64), self.there.astype(np.int64))
        self.next_rank = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.runs: list[Run] = []

    def put(self, parts: tuple[int, ...], bins: int) -> None:
        """``bins`` sequences with the given lengths each."""
        offset = 0
        for length in parts:
            first = int(self.next_rank[length])
            self.runs.append((length, first, first + bins - 1, self.sequences, offset))
            self.next_rank[length] += bins
            offset += length
        self.sequences += bins

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            at_hand = np.flatnonzero(self.there)
            self.pairs[length + at_hand] -= 2
            self.pairs[2 * length] += 1
            self.there[length] = False

    def times(self, parts: tuple[int, ...]) -> int:
        return min(int(self.count[x]) // n for x, n in Counter(parts).items())

    def _two(self, total: int) -> Iterator[tuple[int, int]]:
        for a in np.flatnonzero(self.there[1:total] & self.there[total - 1 : 0 : -1])[::-1] + 1:
            if a >= total - a:
                yield int(a), total - int(a)

    def complement(self, length: int) -> tuple[tuple[int, ...], int]:
        """Lengths that fill a sequence exactly together with ``length``, and how often."""
        gap = self.capacity - length
        if gap == 0:
            return (length,), int(self.count[length])
        if n := self.times((length, gap)):
            return (length, gap), n
        if self.pairs[gap] > 0:
            for two in self._two(gap):
                if n := self.times((length, *two)):
                    return (length, *two), n
        firsts = np.arange(1, gap)
        for a in firsts[self.there[1:gap] & (self.pairs[gap - firsts] > 0)][::-1].tolist():
            for two in self._two(gap - a):
                if n := self.times((length, a, *two)):
                    return (length, a, *two), n
        return (), 0

    def exact(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.count[length]:
                parts, bins = self.complement(length)
                if not bins:
                    break
                self.put(parts, bins)
                for x, n in Counter(parts).items():
                    self.take(x, n * bins)

    def best_fit(self) -> None:
        # open sequences by what is free in them: (lengths, how many)
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {self.capacity: []}
        for length in range(self.capacity, 0, -1):
            left = int(self.count[length])
            while left:
                gap = min((g for g in open_ if g >= length and open_[g]), default=0)
                parts, bins = open_[gap].pop() if gap else ((), 0)
                if not gap:
                    gap, bins = self.capacity, left
                each = min(gap // length, left)
                filled = min(bins, left // each)
                open_.setdefault(gap - each * length, []).append((parts + (length,) * each, filled))
                left -= each * filled
                if bins > filled and parts:
                    open_[gap].append((parts, bins - filled))
        for kinds in open_.values():
            for parts, bins in kinds:
                self.put(parts, bins)


def plan_packing(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs ``(length, first, last, sequence of first, offset)`` and the number of sequences.

    The piece of rank ``first + i`` among those of its length goes to sequence
    ``sequence of first + i``.
    """
    plan = _Plan({k: v for k, v in counts.items() if v}, capacity)
    plan.exact()
    plan.best_fit()
    return plan.runs, plan.sequences


#: White space as itself, for Arrow's expressions, and a text in which cutting at single
#: spaces is not the same as cutting into units: a run of white space with a space in it.
_BLANK = _WHITE.encode().decode("unicode_escape")
_RUNS = f"[{_BLANK}] | [{_BLANK}]"
#: A word of Latin letters and the marks behind it: one or two pieces of the pattern.
_PLAIN = re.compile("( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\\[-^`{-~]*)")


def _numbered(units: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct units and the place of each unit among them."""
    found = units.dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class _Ids:
    """Ids of whole texts by a tokenizer file, with a bounded memo of units."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.units = unit_pattern()
        self.memo: dict[str, bytes] = {}
        #: The characters that stand for bytes in the names of tokens: printable ones are themselves.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.names = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizing pattern."""
        ids = self.memo.get(piece)
        if ids is None:
            if piece.isascii():  # printable but for the space
                named = piece.replace(" ", self.names[32])
            else:
                named = piece.encode().decode("latin-1").translate(self.names)
            found = [t.id for t in self.tokenizer.model.tokenize(named)]
            ids = self.memo[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _remember(self, units: list[str]) -> None:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        others = []
        for unit in units:
            if unit in memo:
                continue
            if plain := _PLAIN.fullmatch(unit):
                word, marks = plain.groups()
                memo[unit] = self._piece(word) + self._piece(marks) if marks else self._piece(word)
            else:
                others.append(unit)
        for at in range(0, len(others), 2_000):
            some = others[at : at + 2_000]
            for unit, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                memo[unit] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _RUNS)
        rows = np.concatenate([np.flatnonzero(~odd.to_numpy(zero_copy_only=False)), np.flatnonzero(odd)])
        words = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        cut = [self.units.findall(t) for t in texts.filter(odd).to_pylist()]
        # the first word of a text has no space before it
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        first = np.zeros(len(flat), bool)
        first[np.cumsum(size) - size] = True
        later, at_later = _numbered(flat.filter(pa.array(~first)))
        leading, at_first = _numbered(flat.filter(pa.array(first)))
        other, at_other = _numbered(pa.array([u for c in cut for u in c], pa.string()))
        known = [f" {w}" for w in later] + leading + other
        self._remember(known)
        places = np.empty(len(flat), np.int64)
        places[~first], places[first] = at_later, at_first + len(later)
        places = np.concatenate([places, at_other + len(later) + len(leading)])
        # the ids of all units side by side, then those of every place
        each = [self.memo[u] for u in known]
        table = np.frombuffer(b"".join(each), "<u4")
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        long = n[places]
        stops = np.cumsum(long)
        ids = table[np.repeat((np.cumsum(n) - n)[places] - (stops - long), long) + np.arange(stops[-1] if len(stops) else 0)]
        units = np.concatenate([size, np.array([len(c) for c in cut], np.int64)])
        ends = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(units)])].tolist()
        out: list[np.ndarray] = [ids[:0]] * len(rows)
        for i, row in enumerate(rows.tolist()):
            out[row] = ids[ends[i] : ends[i + 1]]
        return out


@cache
def _ids(path: str) -> _Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    return _Ids(path)


_PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def _pieces(
    path: str, end_id: int, capacity: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    ids_of = _ids(path)
    end = np.array([end_id], "<u4")
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            rows: list[tuple] = []
            ids_by_row = ids_of(part.column("text"))
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), ids_by_row, strict=True):
                ids = np.concatenate([ids, end])
                n = len(ids)
                stop = (n - 1) % capacity + 1  # the first piece takes what is over
                start = k = 0
                while start < n:
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(ids[start:stop])))
                    start, stop, k = stop, stop + capacity, k + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names)
            )


def pieces_of(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut."""
    rows = slim(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(partial(_pieces, tokenizer, end_id, capacity), _PIECES)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: its cut (see :func:`pieces_of`), sequence_id and offset.

    NULL and empty texts are one piece of the end id alone.  Very long texts become
    many pieces.  Repeated rows and NULL ids are packed one by one; which of two
    equal rows gets which place makes no difference.  An empty table gives an empty
    table.  Other columns are not read.
    """
    spark = docs.sparkSession
    # narrow, and tokenized once: the counts and the numbering both read it
    pieces = written(pieces_of(docs, tokenizer, end_id, capacity, doc_id, text), "pieces")
    # at most capacity rows; a length has as many blocks as its pieces need
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    blocks = spark.createDataFrame(
        [(length, -(-n // BLOCK_ROWS)) for length, n in lengths.items()], "of_length int, blocks bigint"
    )
    pieces = pieces.join(F.broadcast(blocks), F.col("length") == F.col("of_length")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks"))
    )
    # a row per block
    counts = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("length").alias("of"), F.col("block").alias("in"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("over"),
    )
    runs, _ = plan_packing(lengths, capacity)
    plan = spark.createDataFrame(
        runs, "run_length int, first bigint, last bigint, sequence_first bigint, offset bigint"
    )
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = (
        pieces.withColumn("place", F.row_number().over(order) - 1)
        .join(F.broadcast(offsets), (F.col("length") == F.col("of")) & (F.col("block") == F.col("in")))
        .withColumn("rank", F.col("place") + F.col("over"))
    )
    # the number of runs depends on the capacity, not on the number of pieces
    return numbered.join(
        F.broadcast(plan),
        (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("first"), F.col("last")),
    ).select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32",
        (F.col("sequence_first") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset",
    )
