"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into the pieces of the pre-tokenizing pattern.  A task keeps a
bounded memo of pieces it has met; the new pieces of a batch are put in matrices,
one per length bucket, one row per piece.  Each round every row merges its
leftmost pair of minimum rank: the ranks of all pairs come from a hash table of
(left id, right id), rows without a pair leave the matrix, and the rest is
compacted to the left.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankwell.llm.common import slim

#: Pieces that a task remembers before it starts anew.
MEMO = 500_000
#: Cells of one matrix, so that memory stays bounded whatever a batch holds.
CELLS = 1 << 20
#: Bytes of a piece from which its pairs go through a heap.
LONG = 512
#: Documents encoded at once.
PART = 1000
#: Code points with the Unicode property White_Space (fixed values).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = np.int32(1 << 30)
_PAD = np.int32(-1)


def unit_pattern() -> re.Pattern[str]:
    """Cuts a text at white space, where no piece of the pattern can reach across.

    A run of other characters takes the one space before it along, as every
    alternative of the pre-tokenizing pattern does; the rest of a run of white
    space is a unit of its own.
    """
    return re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def piece_pattern(pattern: str) -> regex.Pattern[str]:
    """The pre-tokenizing pattern, with ``\\s`` as the Unicode property."""
    explicit = pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]")
    return regex.compile(explicit.replace(r"\s", f"[{_WHITE}]"))


class Ranks:
    """Ranks of a vocabulary with a hash table of mergeable pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.of_byte = np.full(256, -1, np.int32)
        for b in range(256):
            self.of_byte[b] = ranks.get(bytes([b]), -1)
        pairs = [
            (ranks[piece[:k]], ranks[piece[k:]], rank)
            for piece, rank in ranks.items()
            for k in range(1, len(piece))
            if piece[:k] in ranks and piece[k:] in ranks
        ]
        self.lookup: dict[int, int] | None = None
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        # all pairs are placed at once; those whose slot is taken go one further
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = (table[:, 0] << 32) | table[:, 1]
        values = table[:, 2].astype(np.int32)
        slots = self._slot(keys)
        self.probes = 1
        while len(keys):
            free = self.keys[slots] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]] = keys[put]
            self.values[slots[put]] = values[put]
            keys, values = keys[~put], values[~put]
            slots = (slots[~put] + 1) & (len(self.keys) - 1)
            self.probes += bool(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; a large number where it makes none."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._slot(keys)
        out = np.full(keys.shape, _NONE, np.int32)
        open_ = (left >= 0) & (right >= 0)
        for _ in range(self.probes):
            here = self.keys[slots]
            hit = open_ & (here == keys)
            out[hit] = self.values[slots[hit]]
            open_ &= ~hit & (here != -1)
            if not open_.any():
                break
            slots = (slots + 1) & (len(self.keys) - 1)
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        done = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        while order and len(pieces[order[-1]]) > LONG:
            done[order[-1]] = self._merge_long(pieces[order[-1]])
            order.pop()
        start = 0
        while start < len(order):
            longest = 1 << max(2, (len(pieces[order[start]]) - 1).bit_length())
            end = start
            most = max(1, CELLS // longest)
            while end < len(order) and end - start < most and len(pieces[order[end]]) <= longest:
                end += 1
            self._merge(order[start:end], pieces, done)
            start = end
        return done

    def _merge(self, which: list[int], pieces: list[bytes], done: list[bytes]) -> None:
        """Merge the pieces of one bucket round by round and put their ids in ``done``."""
        raw = [pieces[i] for i in which]
        lengths = np.array([len(p) for p in raw])
        width = max(1, int(lengths.max(initial=1)))
        ids = np.full((len(raw), width), _PAD, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        live = np.array(which)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(live):
            rows = np.arange(len(live))
            if ids.shape[1] < 2:
                at, best = np.zeros(len(live), np.int64), np.full(len(live), _NONE, np.int32)
            else:
                at = ranks.argmin(axis=1)  # the leftmost of the smallest
                best = ranks[rows, at]
            ended = best == _NONE
            if ended.any():
                ends = lengths[ended]
                flat = ids[ended][np.arange(ids.shape[1]) < ends[:, None]].astype("<u4").tobytes()
                stops = (np.cumsum(ends) * 4).tolist()
                for i, n, stop in zip(live[ended].tolist(), (ends * 4).tolist(), stops, strict=True):
                    done[i] = flat[stop - n : stop]
                keep = ~ended
                live, lengths, ids, ranks = live[keep], lengths[keep], ids[keep], ranks[keep]
                at, best, rows = at[keep], best[keep], np.arange(len(live))
                if not len(live):
                    return
            ids[rows, at] = best
            # compaction: what follows the merged pair moves one to the left
            ids = np.where(np.arange(ids.shape[1] - 1) <= at[:, None], ids[:, :-1], ids[:, 1:])
            lengths = lengths - 1
            ids = ids[:, : max(1, int(lengths.max()))]
            if ids.shape[1] < 2:
                ranks = np.empty((len(live), 0), np.int32)
                continue
            ranks = np.where(np.arange(ranks.shape[1] - 1) <= at[:, None], ranks[:, :-1], ranks[:, 1:])
            ranks = ranks[:, : ids.shape[1] - 1]
            for where in (at - 1, at):  # only the two pairs with the new token have other ranks
                ok = (where >= 0) & (where < ranks.shape[1])
                r, c = rows[ok], where[ok]
                ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])

    def _merge_long(self, piece: bytes) -> bytes:
        """A long row by itself: the same merges, each pair found by a heap.

        A matrix would look at the whole row in each round; here a merge only looks at the
        two pairs it makes, so an unbroken run takes little more than linear time.
        """
        if self.lookup is None:
            used = self.keys != -1
            self.lookup = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
        row = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = len(row)
        found = self.rank(row[:-1], row[1:]).astype(np.int64)
        heap = (found * n + np.arange(n - 1))[found != _NONE].tolist()
        heapify(heap)
        ids, ranks = row.tolist(), [*found.tolist(), _NONE]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def place(at: int, left: int, right: int) -> None:
            ranks[at] = self.lookup.get((left << 32) | right, _NONE) if left >= 0 and right >= 0 else _NONE
            if ranks[at] != _NONE:
                heappush(heap, ranks[at] * n + at)

        while heap:
            rank, at = divmod(heappop(heap), n)
            if ranks[at] != rank:
                continue  # merged or changed since
            gone = after[at]
            ids[at], ranks[gone], after[at] = rank, -1, after[gone]
            if after[at] < n:
                before[after[at]] = at
                place(at, rank, ids[after[at]])
            else:
                ranks[at] = _NONE
            if before[at] >= 0:
                place(before[at], ids[before[at]], rank)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return np.array(out).astype("<u4").tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Texts to little-endian ids and back, with a bounded memo of units."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = Ranks(read_ranks(path))
        self.units = unit_pattern()
        self.pattern = piece_pattern(pattern)
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        cut = [self.units.findall(t or "") for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list(set().union(*cut).difference(memo))
        split = self.pattern.findall
        # a run of ASCII letters is one piece, with or without its space
        pieces = [[u] if u.isascii() and u[u[0] == " " :].isalpha() else split(u) for u in new]
        fresh = list({p for ps in pieces for p in ps}.difference(memo))
        ids = self.ranks.encode([p.encode("utf-8", "surrogatepass") for p in fresh])
        memo.update(zip(fresh, ids, strict=True))
        for unit, ps in zip(new, pieces, strict=True):
            if len(ps) > 1:
                memo[unit] = b"".join([memo[p] for p in ps])
        return [b"".join([memo[u] for u in units]) for units in cut]

    def decode(self, ids: bytes) -> bytes:
        pieces = self.ranks.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, pattern)


def _encode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = encoder(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            ids = coder.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())),
                ],
                names=["doc_id", "ids"],
            )


def encode_texts(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, ids) per input row; NULL and empty texts have no ids.

    Texts are encoded whole, special tokens are ordinary text.  No row depends on
    another, so repeated rows, ties and NULL ids need no rule; an empty table gives
    an empty table; other columns are not read.
    """
    rows = slim(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(partial(_encode, path, pattern), "doc_id bigint, ids array<int>")


def _decode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = encoder(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            ids = [np.asarray(i or [], "<u4").tobytes() for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([coder.decode(i) for i in ids], pa.binary()),
                ],
                names=["doc_id", "bytes"],
            )


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) for (doc_id, ids); NULL lists give no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(_decode, path, pattern), "doc_id bigint, bytes binary"
    )


_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = encoder(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            ids = coder.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def round_trip_digests(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode, then decode the ids, in one pass: the digests of both, and the length.

    As :func:`encode_texts` followed by :func:`decode_ids`, without carrying ids
    between them.
    """
    rows = slim(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(partial(_digests, path, pattern), _DIGESTS)
