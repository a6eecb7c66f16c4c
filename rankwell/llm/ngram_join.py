"""N-gram Jaccard join with token-combination prefixes.

The tokens of a document are its distinct word shingles.  All tokens are ordered from
rare to frequent by exact counts of hash buckets, taken over every document.  Two
documents that are similar enough share a token in the prefix of that order, and k
tokens in a prefix that is k - 1 longer.  So the prefix is extended by one, its rare
tokens are indexed one by one, and its frequent tokens (a bounded class) by all their
pairs.  The remaining length of a document behind a shared token bounds the overlap;
what passes meets the other's sketch, which bounds the overlap from above, and is then
verified on the whole sets.  So only pairs that are nearly all links ask for whole sets.

Equal sets are one document from the start.  Copies in large groups need not meet in
all pairs for the components to be right: first every document is compared with one hub
of the lists it stands in, then with one of another component, and only then all pairs
of a list that are still in different components.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.common import SHINGLE_WORDS, slim
from rankwell.llm.components import components
from rankwell.session import discard, release_shuffles, written, written_bucketed

#: Buckets of the table of counts, and pieces in which it moves.
BUCKET_BITS = 20
CHUNKS = 64
#: A token is frequent if its bucket holds more than this share of all tokens, so there
#: are at most so many of them.
FREQUENT = 1 << 14
#: Words that a task remembers before it starts anew.
MEMO = 300_000
#: Bits of a sketch per token at least, and words of 64 bits in the table of wanted ids.
SKETCH_BITS = 2
WANTED_WORDS = 1 << 16
#: At least 3/4: 4 * intersection >= 3 * union, or 7 * intersection >= 3 * sum of sizes.
_SHARE, _SUM = 3, 7

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(33)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _M1
    h = (h ^ (h >> _SHIFT)) * _M2
    return h ^ (h >> _SHIFT)


class Shingler:
    """The set of 64-bit shingle hashes of a text, sorted."""

    def __init__(self, words: int = SHINGLE_WORDS) -> None:
        self.words = words
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        # bytes.lower and bytes.split know ASCII only, as the contract does
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        size = min(self.words, len(h))
        rolled = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            rolled = rolled * _STEP + h[i : len(h) - size + 1 + i]
        return np.unique(_mixed(rolled))


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def sketch(tokens: np.ndarray) -> bytes:
    """The size of a set, and for each low end of a hash the parity of its tokens.

    A token on one side only flips one bit, so two sets differ in at least as many tokens
    as their sketches in bits.  The bits are a power of two.
    """
    bits = 64
    while bits < SKETCH_BITS * len(tokens):
        bits *= 2
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(tokens).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(x: bytes | None, y: bytes | None) -> bool:
    """Whether sets with these sketches may be similar enough; without a sketch they may."""
    if x is None or y is None:
        return True
    total = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
    p, q = np.frombuffer(x, np.uint8, offset=8), np.frombuffer(y, np.uint8, offset=8)
    while len(p) != len(q):  # halves of the longer one add up to a shorter one
        if len(p) < len(q):
            p, q = q, p
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    differ = int(np.bitwise_count(p ^ q).sum())
    return _SUM * (total - differ) >= 2 * _SHARE * total


_PROFILE = "doc_id bigint, n bigint, signature binary, sketch binary, chunk int, counts binary"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end of a task its counts per bucket."""
    shingler = Shingler()
    counts = np.zeros(1 << BUCKET_BITS, np.uint32)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("sketch", pa.binary()),
         ("chunk", pa.int32()), ("counts", pa.binary())]
    )
    for batch in batches:
        sets = [shingler(t) for t in _bytes(batch.column("text"))]
        held = np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - BUCKET_BITS)
        counts += np.bincount(held.astype(np.int64), minlength=len(counts)).astype(np.uint32)
        none = pa.nulls(len(sets))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([sketch(s) for s in sets], pa.binary()),
                none.cast(pa.int32()),
                none.cast(pa.binary()),
            ],
            schema=schema,
        )
    parts = np.split(counts, CHUNKS)
    full = [i for i, p in enumerate(parts) if p.any()]
    none = pa.nulls(len(full))
    yield pa.RecordBatch.from_arrays(
        [
            none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()),
            pa.array(full, pa.int32()),
            pa.array([zlib.compress(parts[i].tobytes(), 1) for i in full], pa.binary()),
        ],
        schema=schema,
    )


def _added(pieces: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in pieces["counts"])
    return pd.DataFrame({"chunk": [pieces["chunk"].iloc[0]], "counts": [np.asarray(total).tobytes()]})


def token_classes(profile: DataFrame) -> tuple[np.ndarray, int]:
    """Class of each bucket, from rare to frequent, and the first frequent class.

    The table has a fixed size, however many documents there are.
    """
    rows = (
        profile.filter("chunk IS NOT NULL").select("chunk", "counts")
        .groupBy("chunk").applyInPandas(_added, "chunk int, counts binary").collect()
    )
    counts = np.zeros((CHUNKS, (1 << BUCKET_BITS) // CHUNKS), np.int64)
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    counts = counts.ravel()
    classes = np.ceil(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    least = max(2.0, counts.sum() / FREQUENT, 2.0 * counts.sum() / len(counts))
    return classes, int(np.ceil(2 * np.log2(least))) + 1


def prefix_keys(tokens: np.ndarray, classes: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and the largest overlap that each still allows.

    A shared key is the first shared token, or the first two if they are frequent.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cls = classes[(tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.argsort(cls, kind="stable")
    length = min(n, n - -(-3 * n // 4) + 2)  # one more than a single token needs
    head, often = tokens[order[:length]], cls[order[:length]] >= frequent
    single = np.flatnonzero(~often)
    single = single[single < max(1, length - 1)]
    keys, rest = [head[single]], [n - single]
    pairs = np.array(list(combinations(np.flatnonzero(often).tolist(), 2)), np.int64).reshape(-1, 2)
    if len(pairs):
        one, two = head[pairs[:, 0]], head[pairs[:, 1]]
        keys.append(_mixed(_mixed(one) * _STEP + two))
        rest.append(n - pairs[:, 1] + 1)
    return np.concatenate(keys), np.concatenate(rest)


_KEYS = "doc_id bigint, n int, signature binary, keys array<bigint>, rest array<int>"


def _indexed(
    classes: np.ndarray, frequent: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
        found: list[tuple] = []
        for doc_id, text in zip(ids, _bytes(batch.column("text")), strict=True):
            s = shingler(text)
            if doc_id is None or not len(s):
                continue
            keys, rest = prefix_keys(s, classes, frequent)
            signature = blake2b(s.tobytes(), digest_size=16).digest()
            found.append((doc_id, len(s), signature, keys.view(np.int64), rest.astype(np.int32)))
        columns = list(zip(*found, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["doc_id", "n", "signature", "keys", "rest"],
        )


def _shared_lists(docs: DataFrame, classes: np.ndarray, frequent: int) -> DataFrame:
    """(key, rep, n, rest, low, high): the lists of two or more, with their end members."""
    indexed = docs.mapInArrow(partial(_indexed, classes, frequent), _KEYS)
    # one row per set; copies fold together before they move
    sets = indexed.groupBy("signature").agg(
        F.min(F.struct("doc_id", "n", "keys", "rest")).alias("s")
    )
    entries = sets.select(
        F.col("s.doc_id").alias("rep"), F.col("s.n").alias("n"),
        F.explode(F.arrays_zip(F.col("s.keys").alias("key"), F.col("s.rest").alias("rest"))).alias("e"),
    ).select(F.col("e.key").alias("key"), "rep", "n", F.col("e.rest").alias("rest"))
    whole = Window.partitionBy("key")
    member = F.struct("rep", "n", "rest")
    return (
        entries.withColumn("low", F.min(member).over(whole))
        .withColumn("high", F.max(member).over(whole))
        .filter(F.col("low.rep") < F.col("high.rep"))
    )


def _possible(n: str, rest: str, other_n: str, other_rest: str):
    """Length and positional filter."""
    overlap = F.least(F.col(rest), F.col(other_rest))
    total = F.col(n) + F.col(other_n)
    return (
        (4 * F.least(F.col(n), F.col(other_n)) >= 3 * F.greatest(F.col(n), F.col(other_n)))
        & (_SUM * overlap >= _SHARE * total)
    )


def _similar(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(x) + len(y) - len(np.union1d(x, y))
    return _SUM * both >= _SHARE * (len(x) + len(y))


def _passing(test: Callable[[bytes, bytes], bool], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = (batch.column(c).to_pylist() for c in ("held_a", "held_b"))
        mask = pa.array([test(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"]
        )


def _tested(pairs: DataFrame, held: DataFrame, test: Callable[[bytes, bytes], bool], name: str) -> DataFrame:
    """The pairs (a, b) whose ``held`` values pass the test; the pairs go.

    ``held`` is bucketed by rep, so only pairs move to it.  The values of the hubs are
    written plainly: the join with them then has a shuffle on either side, and a hub
    with very many pairs is split.
    """
    left = held.select(F.col("rep").alias("ra"), F.col("held").alias("held_a"))
    hubs = pairs.select("a").distinct().join(left, F.col("a") == F.col("ra"))
    hubs = written(hubs.select("ra", "held_a"), "hubs")
    right = held.select(F.col("rep").alias("rb"), F.col("held").alias("held_b"))
    both = pairs.join(right, F.col("b") == F.col("rb")).join(hubs, F.col("a") == F.col("ra"))
    both = both.select("a", "b", "held_a", "held_b")
    found = written(both.mapInArrow(partial(_passing, test), "a bigint, b bigint"), name)
    discard(hubs)
    discard(pairs)
    release_shuffles(found.sparkSession)
    return found


def _bit(doc_id: str) -> tuple[Column, Column]:
    """The word and the bit of an id in the table of wanted ids."""
    hashed = F.xxhash64(doc_id)
    return F.pmod(hashed, F.lit(WANTED_WORDS)).cast("int"), F.shiftrightunsigned(hashed, 58).cast("int")


def _wanted_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids ``wanted``, the least text of each.

    A table of bits, of a fixed size, first leaves out nearly all other rows where they are;
    the join is exact.
    """
    word, bit = _bit("wanted")
    one = F.lit(1).cast("bigint")
    words = [0] * WANTED_WORDS
    for r in wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folds to one literal
    word, bit = _bit("doc_id")
    maybe = F.call_function("shiftright", F.get(table, word), bit).bitwiseAND(one) == 1
    texts = rows.filter("doc_id IS NOT NULL").filter(maybe)
    texts = texts.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"))


def _links(pairs: DataFrame, sketches: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, by their sketches first."""
    spark = rows.sparkSession
    near = _tested(written(pairs.select("a", "b"), "pairs"), sketches, may_link, "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
    # bucketed: the sets stay where they are while pairs come and go
    sets, table = written_bucketed(_wanted_texts(rows, wanted).mapInArrow(_token_sets, _SETS), "sets", "rep")
    release_shuffles(spark)
    found = _tested(near, sets, _similar, "links")
    _dropped(sets, table)
    return found


def _dropped(frame: DataFrame, table: str) -> None:
    discard(frame)
    frame.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    release_shuffles(frame.sparkSession)


_SETS = "rep bigint, held binary"


def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([shingler(t).tobytes() for t in _bytes(batch.column("text"))], pa.binary()),
            ],
            names=["rep", "held"],
        )


def _with_component(lists: DataFrame, comps: DataFrame) -> DataFrame:
    labels = comps.select(F.col("node").alias("of"), F.col("component").alias("known"))
    return lists.join(labels, F.col("rep") == F.col("of"), "left").withColumn(
        "comp", F.coalesce("known", "rep")
    ).drop("of", "known")


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """Each document with the one hub that it shares the most lists with."""
    pairs = lists.filter(F.col("rep") != F.col("hub.rep")).filter(
        _possible("n", "rest", "hub.n", "hub.rest")
    )
    counted = pairs.groupBy("rep", F.col("hub.rep").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    best = counted.groupBy("rep").agg(F.max(F.struct("c", (-F.col("h")).alias("back"))).alias("m"))
    return best.select((-F.col("m.back")).alias("a"), F.col("rep").alias("b"))


def _with_other_hub(lists: DataFrame) -> DataFrame:
    """A hub of another component for every member of a list."""
    whole = Window.partitionBy("key")
    member = F.struct("comp", "rep", "n", "rest")
    low, high = F.min(member).over(whole), F.max(member).over(whole)
    ends = lists.withColumn("c1", low).withColumn("c2", high)
    return ends.withColumn("hub", F.when(F.col("comp") == F.col("c1.comp"), F.col("c2")).otherwise(F.col("c1")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents are linked when 100 * intersection >= 75 * union of their sets;
    ``component_id`` is the smallest id reachable by links.  NULL and empty texts, and
    rows with a NULL id, are linked with nothing: they are their own component (NULL
    for a NULL id).  Repeated rows are one node; of different texts under one id the
    least is compared.  Very long texts are read whole.  An empty table gives an empty table.
    Other columns are not read.
    """
    rows = slim(docs, doc_id=doc_id, text=text)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    profile = written(rows.mapInArrow(_profile, _PROFILE), "profile")
    classes, frequent = token_classes(profile)
    lists = written(_shared_lists(rows, classes, frequent), "lists")
    release_shuffles(docs.sparkSession)
    # sketches of the documents that stand in a shared list at all; none of an id with several texts
    in_lists = lists.select(F.col("rep").alias("wanted")).distinct()
    sketches = profile.filter("chunk IS NULL").select("doc_id", "signature", "sketch")
    sketches = sketches.join(in_lists, F.col("doc_id") == F.col("wanted"), "left_semi").groupBy("doc_id").agg(
        F.when(F.min("signature") == F.max("signature"), F.min("sketch")).alias("held")
    )
    sketches, table = written_bucketed(sketches.withColumnRenamed("doc_id", "rep"), "sketches", "rep")
    release_shuffles(docs.sparkSession)

    first = _hub_pairs(lists.withColumn("hub", F.col("low")))
    found = _links(first, sketches, rows)
    second = _hub_pairs(_with_other_hub(_open_lists(lists, components(found))))
    found = _joined(found, _links(second, sketches, rows))
    open_ = written(_open_lists(lists, components(found)), "open")
    discard(lists)
    release_shuffles(docs.sparkSession)
    found = _joined(found, _links(_open_pairs(open_), sketches, rows))
    discard(open_)
    _dropped(sketches, table)

    # copies of a set are linked to the smallest id among them
    per_doc = profile.filter("chunk IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "signature")
    known = per_doc.filter("doc_id IS NOT NULL AND n_shingles > 0")
    copies = known.groupBy("signature").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c"))
    copies = copies.filter("c > 1").withColumnRenamed("signature", "sig")
    same = known.join(copies, F.col("signature") == F.col("sig")).select(
        F.col("first").alias("a"), F.col("doc_id").alias("b")
    )
    final = components(found.union(same)).withColumnRenamed("node", "of")
    return per_doc.join(final, F.col("doc_id") == F.col("of"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    both = written(found.union(more), "found")
    discard(found)
    discard(more)
    return both


def _open_lists(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The lists that still hold members of different components."""
    labelled = _with_component(lists, comps)
    ends = labelled.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    ends = ends.filter("c1 < c2").select(F.col("key").alias("open_key"))
    return labelled.join(ends, F.col("key") == F.col("open_key"), "left_semi")


def _open_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of a list that are in different components and pass the filters."""
    x = lists.select(*[F.col(c).alias(f"x_{c}") for c in ("key", "rep", "n", "rest", "comp")])
    y = lists.select(*[F.col(c).alias(f"y_{c}") for c in ("key", "rep", "n", "rest", "comp")])
    pairs = x.join(
        y,
        (F.col("x_key") == F.col("y_key")) & (F.col("x_rep") < F.col("y_rep"))
        & (F.col("x_comp") != F.col("y_comp")) & _possible("x_n", "x_rest", "y_n", "y_rest"),
    )
    return pairs.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).distinct()
