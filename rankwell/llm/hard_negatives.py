"""Hard negatives by coordinate pruning over length buckets.

For each anchor the best rows of its own label are its positives, and for each positive
the best rows of other labels whose score lies in a window below the positive's score are
its hard negatives.  Both searches ask for the rows with an inner product of at least some
floor, which rises as rows are found.

Rows are packed into groups.  Inside a group the rows of one label are ordered by length
and cut into buckets, and each bucket holds a sorted list per coordinate.  For an anchor, a
bucket's longest vector turns the floor into a least cosine, and this into a feasible
range of values in each of the anchor's largest (focus) coordinates.  The ranges are looked
up in the sorted lists, the shortest gives the candidates, the others cut it down, and so
does a bound from all focus coordinates together.  What is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.common import slim
from rankwell.llm.topk_search import quantised
from rankwell.session import written

#: Rows of a group, about; anchors in a block; rows in a length bucket.
GROUP = 8192
ANCHORS = 256
BUCKET = 512
#: Coordinates of an anchor with a feasible range, and those in the joint bound.
FOCUS = 4
JOINT = 16
#: Pairs that are looked at together.
PAIRS = 1 << 18
#: Bytes of a block at most; long vectors make more blocks.
BLOCK_BYTES = 8 << 20
#: Rounding of cosines and bounds lies far below.
SLACK = 1e-9
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class Bucket:
    """Vectors of one label and similar length, with a sorted list per coordinate."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, lengths: np.ndarray) -> None:
        self.rows, self.ids, self.keys = rows, ids, keys
        self.longest = float(lengths.max(initial=0.0))
        self.unit = rows / np.where(lengths > 0, lengths, 1.0)[:, None]
        #: Rows by value, and the values in that order, per coordinate.
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.values = np.take_along_axis(self.unit, self.order, axis=0)
        self.squares = self.unit**2

    def candidates(self, anchors: Anchors, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(anchor, row) pairs whose score may reach the anchor's floor, a part at a time."""
        need = np.full(len(floor), -1.0)
        scale = anchors.lengths * self.longest
        # shorter vectors need a lower cosine below zero, so such floors close nothing
        some = (scale > 0) & (floor >= 0)
        need[some] = floor[some] / scale[some] - SLACK
        # a floor above the longest product closes the bucket; a zero product reaches 0 only
        open_ = np.flatnonzero(np.where(scale > 0, need <= 1.0, floor <= 0))
        if not len(open_):
            return
        if self.rows.shape[1] == 0:
            row = np.arange(len(self.ids))
            for i in open_:
                yield np.full(len(row), i), row
            return
        low, high = anchors.feasible(open_, need[open_])
        starts, counts = np.empty(low.shape, np.int64), np.empty(low.shape, np.int64)
        focus = anchors.focus[open_]
        for f in np.unique(focus):
            here = focus == f
            starts[here] = np.searchsorted(self.values[:, f], low[here] - SLACK, "left")
            counts[here] = np.searchsorted(self.values[:, f], high[here] + SLACK, "right")
        counts -= starts
        # the shortest list; empty ranges end the anchor
        shortest = counts.argmin(axis=1)
        at = np.arange(len(open_))
        sizes = np.maximum(0, counts[at, shortest])
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(open_):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            part = np.arange(begin, stop)
            n = sizes[part]
            which = np.repeat(part, n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            lists = focus[which, shortest[which]]
            row = self.order[starts[which, shortest[which]] + inside, lists]
            yield self._cut(anchors, open_, need, low, high, which, row)
            begin = stop

    def _cut(self, anchors, open_, need, low, high, which, row) -> tuple[np.ndarray, np.ndarray]:
        """Pairs inside the other feasible ranges and under the joint bound."""
        for k in range(low.shape[1]):
            value = self.unit[row, anchors.focus[open_[which], k]]
            fits = (value >= low[which, k] - SLACK) & (value <= high[which, k] + SLACK)
            if not fits.all():
                which, row = which[fits], row[fits]
        joint = anchors.joint[open_]
        if joint.shape[1] < self.unit.shape[1] and len(which):
            seen = np.zeros(len(which))
            rest = np.ones(len(which))
            for k in range(joint.shape[1]):
                f = joint[which, k]
                seen += self.unit[row, f] * anchors.unit[open_[which], f]
                rest -= self.squares[row, f]
            most = seen + np.sqrt(np.maximum(0, rest) * anchors.rest[open_[which]])
            fits = most >= need[open_[which]] - SLACK
            which, row = which[fits], row[fits]
        return open_[which], row


class Anchors:
    """A block of anchors with their focus coordinates, largest first."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> None:
        self.rows, self.ids, self.keys, self.labels = rows, ids, keys, labels
        self.lengths = np.sqrt((rows**2).sum(axis=1))
        self.unit = rows / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        largest = np.argsort(-np.abs(self.unit), axis=1, kind="stable")
        self.focus, self.joint = largest[:, :FOCUS], largest[:, :JOINT]
        chosen = np.take_along_axis(self.unit, self.joint, axis=1)
        #: Squared length outside the joint coordinates.
        self.rest = np.maximum(0, 1 - (chosen**2).sum(axis=1))

    def feasible(self, which: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of each focus coordinate of a unit vector with a cosine of ``need`` or more.

        The angles of both vectors to the coordinate's axis differ by their own angle at most.
        """
        own = np.arccos(np.clip(np.take_along_axis(self.unit[which], self.focus[which], axis=1), -1, 1))
        apart = np.arccos(np.clip(need, -1, 1))[:, None] + 1e-7
        return np.cos(np.minimum(np.pi, own + apart)), np.cos(np.maximum(0, own - apart))


def exact_scores(q: np.ndarray, x: np.ndarray, query: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Inner products of the pairs as int64; products beyond a long are cut to its range."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most >= _EXACT:
        sums = [sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)) for i, j in zip(query, cand, strict=True)]
        return np.array([max(-_LONG - 1, min(_LONG, s)) for s in sums], np.int64)
    if len(query) > 0.05 * len(q) * len(x):
        return (q @ x.T)[query, cand].astype(np.int64)
    return np.einsum("ij,ij->i", q[query], x[cand]).astype(np.int64)


def _best(rows: list[tuple], new: Iterator[tuple], k: int) -> list[tuple]:
    return sorted([*rows, *new])[:k]


class Group:
    """The rows of a group as buckets per label, longest vectors first."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> None:
        lengths = np.sqrt((rows**2).sum(axis=1))
        self.buckets: dict[int, list[Bucket]] = {}
        for label in np.unique(labels):
            of = np.flatnonzero(labels == label)
            of = of[np.argsort(-lengths[of], kind="stable")]
            cuts = [of[i : i + BUCKET] for i in range(0, len(of), BUCKET)]
            self.buckets[int(label)] = [Bucket(rows[c], ids[c], keys[c], lengths[c]) for c in cuts]

    def positives(self, anchors: Anchors, k: int) -> Iterator[tuple]:
        """(anchor, -score, id, key): the k best rows of the anchor's label."""
        best: list[list[tuple]] = [[] for _ in anchors.ids]
        floor = np.full(len(anchors.ids), -np.inf)
        for label, buckets in self.buckets.items():
            mine = anchors.labels == label
            for bucket in buckets if mine.any() else []:
                for query, row in bucket.candidates(anchors, np.where(mine, floor, np.inf)):
                    other = (anchors.ids[query] != bucket.ids[row]) | (anchors.keys[query] != bucket.keys[row])
                    query, row = query[other], row[other]
                    score = exact_scores(anchors.rows, bucket.rows, query, row)
                    good = score >= floor[query]
                    for i, new in _by_anchor(query[good], score[good], bucket.ids[row[good]], bucket.keys[row[good]], k):
                        best[i] = _best(best[i], new, k)
                        if len(best[i]) == k:
                            floor[i] = -best[i][-1][0]
        for i, rows in enumerate(best):
            for row in rows:
                yield i, *row

    def negatives(self, anchors: Anchors, bounds: list[list[int]], k: int, low: int, high: int) -> Iterator[tuple]:
        """(anchor, number of the bound, -score, id, key): the k best other labels in each window.

        The window of a bound b is low * b <= 100 * score <= high * b.
        """
        best: list[list[list[tuple]]] = [[[] for _ in b] for b in bounds]
        tops = [[high * b // 100 for b in of] for of in bounds]
        floors = [[-(-low * b // 100) for b in of] for of in bounds]

        def least(i: int) -> float:
            open_ = [f for f, t in zip(floors[i], tops[i], strict=True) if f <= t]
            return float(min(open_)) if open_ else np.inf

        floor = np.array([least(i) for i in range(len(bounds))])
        for label, buckets in self.buckets.items():
            theirs = anchors.labels != label
            for bucket in buckets if theirs.any() else []:
                for query, row in bucket.candidates(anchors, np.where(theirs, floor, np.inf)):
                    score = exact_scores(anchors.rows, bucket.rows, query, row)
                    good = score >= floor[query]
                    query, row, score = query[good], row[good], score[good]
                    for i, (begin, end) in zip(*_runs(query), strict=True):
                        ids, keys = bucket.ids[row[begin:end]], bucket.keys[row[begin:end]]
                        for b, (f, t) in enumerate(zip(floors[i], tops[i], strict=True)):
                            fits = (score[begin:end] >= f) & (score[begin:end] <= t)
                            if not fits.any():
                                continue
                            new = next(_by_anchor(np.zeros(int(fits.sum()), int), score[begin:end][fits], ids[fits], keys[fits], k))[1]
                            best[i][b] = _best(best[i][b], new, k)
                            if len(best[i][b]) == k:
                                floors[i][b] = max(f, -best[i][b][-1][0])
                        floor[i] = least(i)
        for i, windows in enumerate(best):
            for b, rows in enumerate(windows):
                for row in rows:
                    yield i, b, *row


def _runs(query: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    found, starts = np.unique(query, return_index=True)
    edges = [*starts.tolist(), len(query)]
    return found.tolist(), list(zip(edges[: len(found)], edges[1:], strict=True))


def _by_anchor(query, score, ids, keys, k) -> Iterator[tuple[int, list[tuple]]]:
    """Per anchor the rows that can be among its k best: (-score, id, key).  Anchors ascend."""
    for i, (begin, end) in zip(*_runs(query), strict=True):
        of = np.arange(begin, end)
        if len(of) > 4 * k:  # ties at the cut stay: the smaller id decides among them
            of = of[score[of] >= np.partition(score[of], len(of) - k)[len(of) - k]]
        yield i, list(zip((-score[of]).tolist(), ids[of].tolist(), keys[of].tolist(), strict=True))


_BLOCKS = "part int, dim int, ids binary, keys binary, labels binary, rows binary"


def _packed(size: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (part, vec_id, akey, label, v) as blocks of one part and dimension."""
    held: dict[tuple[int, int], list[tuple]] = {}

    def block(of: tuple[int, int]) -> pd.DataFrame:
        ids, keys, labels, rows = zip(*held.pop(of), strict=True)
        whole = [np.array(c, np.int64).tobytes() for c in (ids, keys, labels)]
        made = [*of, *whole, np.concatenate(rows).astype(np.float64).tobytes()]
        return pd.DataFrame([made], columns=["part", "dim", "ids", "keys", "labels", "rows"])

    for batch in batches:
        for part, vec_id, key, label, v in batch[["part", "vec_id", "akey", "label", "v"]].itertuples(index=False):
            of = (int(part), len(v))
            held.setdefault(of, []).append((vec_id, key, label, np.asarray(v, np.float64)))
            if len(held[of]) >= min(size, BLOCK_BYTES // (8 * max(1, len(v))) + 1):
                yield block(of)
    for of in list(held):
        yield block(of)


def _unpacked(ids: bytes, keys: bytes, labels: bytes, rows: bytes, dim: int) -> tuple[np.ndarray, ...]:
    own = [np.frombuffer(c, np.int64) for c in (ids, keys, labels)]
    return np.frombuffer(rows, np.float64).reshape(len(own[0]), dim), *own


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Group, Anchors, object]]:
    """Groups come in runs, so their lists are built once a run."""
    last, group = None, None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.keys != last:
                last, group = row.keys, Group(*_unpacked(row.ids, row.keys, row.labels, row.rows, row.dim))
            yield group, Anchors(*_unpacked(row.a_ids, row.a_keys, row.a_labels, row.a_rows, row.dim)), row


def _find_positives(k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["anchor_id", "akey", "score", "positive_id", "positive_key"]
    for group, anchors, _ in _meetings(batches):
        found = [
            (anchors.ids[i], anchors.keys[i], -score, other, key)
            for i, score, other, key in group.positives(anchors, k)
        ]
        yield pd.DataFrame(found, columns=names).astype("int64")


def _find_negatives(k: int, low: int, high: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["anchor_id", "akey", "place", "score", "negative_id", "negative_key"]
    for group, anchors, row in _meetings(batches):
        scores = np.frombuffer(row.bounds, np.int64)
        ends = np.cumsum(np.frombuffer(row.sizes, np.int64))
        bounds = [part.tolist() for part in np.split(scores, ends[:-1])]
        found = [
            (anchors.ids[i], anchors.keys[i], b, -score, other, key)
            for i, b, score, other, key in group.negatives(anchors, bounds, k, low, high)
        ]
        yield pd.DataFrame(found, columns=names).astype("int64")


def _bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As :func:`_packed` for anchors, with the scores of their positives."""
    for batch in batches:
        for part, of_part in batch.groupby("part", sort=True):
            for dim, rows in of_part.groupby(of_part["v"].map(len), sort=True):
                for at in range(0, len(rows), ANCHORS):
                    cut = rows.iloc[at : at + ANCHORS]
                    ints = [cut[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "akey", "label")]
                    sizes = cut["bounds"].map(len).to_numpy(np.int64)
                    bounds = np.concatenate([*map(np.asarray, cut["bounds"]), np.zeros(0)]).astype(np.int64)
                    vectors = np.concatenate([np.asarray(v, np.float64) for v in cut["v"]])
                    yield pd.DataFrame(
                        [[part, dim, *ints, vectors.tobytes(), bounds.tobytes(), sizes.tobytes()]],
                        columns=["part", "dim", "ids", "keys", "labels", "rows", "bounds", "sizes"],
                    )


def _against(blocks: DataFrame, groups: DataFrame, parts: int, extra: list[Column]) -> DataFrame:
    """Each block of anchors with each group of its dimension, groups in runs."""
    anchors = blocks.select(
        F.col("dim").alias("a_dim"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "keys", "labels", "rows")], *extra,
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("a_part"),
    )
    return groups.hint("merge").join(anchors, (F.col("part") == F.col("a_part")) & (F.col("dim") == F.col("a_dim"))).drop(
        "a_dim", "a_part", "part"
    )


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are its
    first ``positives`` other rows of the same label, its negatives per positive the first
    ``negatives`` rows of other labels with low * p <= 100 * score <= high * p, where p is the
    positive's score; fewer if there are fewer.  Scores are inner products of
    floor(256 * x), higher first, ties by the smaller id.

    Rows with a NULL id or label, a NULL vector or a NULL or non-finite component take no
    part.  Rows equal in id, label and vector are one; rows of one id that differ are rows of
    their own.  Vectors meet those of the same dimension only; empty vectors score 0.  An
    empty table gives an empty table; other columns are not read.
    """
    rows = slim(vectors, vec_id=vec_id, embedding=embedding, label=label).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        quantised(F.col("embedding")).alias("v"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").distinct()
    rows = rows.withColumn("akey", F.xxhash64("label", "v"))
    parts = max(1, -(-rows.count() // GROUP))
    # by id and vector, so that neither a hot label nor a hot id fills a group
    placed = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "akey"), F.lit(parts)).cast("int"))
    groups = written(
        placed.repartition(parts, "part").mapInPandas(partial(_packed, 2 * GROUP), _BLOCKS), "vectors"
    )
    chosen = placed.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-parts * GROUP // (every * ANCHORS)))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("akey", "vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    packed = chosen.repartition(blocks, "part").mapInPandas(partial(_packed, ANCHORS), _BLOCKS)
    found = _against(packed, groups, parts, []).mapInPandas(
        partial(_find_positives, positives),
        "anchor_id bigint, akey bigint, score bigint, positive_id bigint, positive_key bigint",
    )
    order = Window.partitionBy("anchor_id", "akey").orderBy(F.col("score").desc(), "positive_id", "positive_key")
    # at most ``positives`` rows an anchor from each group
    top = written(
        found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives), "positives"
    )
    bounds = top.groupBy("anchor_id", "akey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("bounds")
    ).withColumnRenamed("akey", "key")
    known = chosen.join(bounds, (F.col("vec_id") == F.col("anchor_id")) & (F.col("akey") == F.col("key")))
    with_bounds = known.select("part", "vec_id", "akey", "label", "v", "bounds").repartition(blocks, "part").mapInPandas(
        _bounded, _BLOCKS + ", bounds binary, sizes binary"
    )
    mined = _against(with_bounds, groups, parts, [F.col("bounds"), F.col("sizes")]).mapInPandas(
        partial(_find_negatives, negatives, low, high),
        "anchor_id bigint, akey bigint, place int, score bigint, negative_id bigint, negative_key bigint",
    )
    order = Window.partitionBy("anchor_id", "akey", "place").orderBy(F.col("score").desc(), "negative_id", "negative_key")
    ranked = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = top.select(
        F.col("anchor_id").alias("a"), F.col("akey").alias("k"), F.col("place").alias("p"), "positive_id",
        F.col("score").alias("positive_score"),
    )
    joined = ranked.join(names, (F.col("anchor_id") == F.col("a")) & (F.col("akey") == F.col("k")) & (F.col("place") == F.col("p")))
    return joined.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")
    )


def mined_negatives(vectors: DataFrame) -> DataFrame:
    """:func:`hard_negatives` after rows with an id divisible by 7 moved to the next of ten labels."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = slim(vectors, vec_id="vec_id", embedding="embedding", label="label")
    return hard_negatives(rows.withColumn("label", moved))
