"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments; mean and deviation of each segment bound distances
from below: in a segment of length n, |q - x|^2 >= n ((mq - mx)^2 + (sq - sx)^2),
and so the inner product from above, since 2 q.x = |q|^2 + |x|^2 - |q - x|^2.  The
bounds are taken from few long segments to many short ones; only candidates whose
bound still reaches the k-th best score are compared exactly.

Queries and candidates are packed into blocks.  Each block of queries meets each
group of candidates once, and a group yields k rows a query, so what moves is the
queries times the number of groups, never a pair of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.common import slim

#: Segments per level, coarse to fine.
LEVELS = (4, 8, 16, 32)
#: Vectors in a block of queries, and in a block of candidates.
QUERY_BLOCK = 512
BLOCK = 4096
#: Candidates of one group, about.
GROUP = 16_384
#: Every exact float64 sum of integer products lies below.
_EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; NULL if a component is NULL or not finite."""
    double = vector.cast("array<double>")
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(double, lambda x: F.floor(x * scale).cast("double"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def _packed(size: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, vec_id, v) as blocks of one key and one dimension each."""
    held: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}

    def block(key: tuple[int, int]) -> pd.DataFrame:
        rows = held.pop(key)
        ids = np.array([i for i, _ in rows], np.int64)
        return pd.DataFrame(
            {"key": [key[0]], "dim": [key[1]], "ids": [ids.tobytes()],
             "rows": [np.concatenate([v for _, v in rows]).tobytes() if key[1] else b""]}
        )

    for batch in batches:
        for key, vec_id, v in zip(batch["key"], batch["vec_id"], batch["v"], strict=True):
            at = (int(key), len(v))
            held.setdefault(at, []).append((vec_id, np.asarray(v, np.float64)))
            if len(held[at]) == size:
                yield block(at)
    for at in list(held):
        yield block(at)


_BLOCKS = "key int, dim int, ids binary, rows binary"


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose dot product bounds the inner product from above.

    Per segment: mean times sqrt(n), and the root of the summed squares about it.
    """
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.hstack([sums / np.sqrt(n), np.sqrt(np.maximum(0, squares - sums * sums / n))])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of q and x, row by row, as int64."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < _EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    top = (1 << 63) - 1
    exact = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
    return np.array([max(-top - 1, min(top, e)) for e in exact], np.int64)


class _Best:
    """The k best candidates of each query so far: higher score, then smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.floor = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of queries, which come in ascending order."""
        for q, rows in zip(*_runs(query), strict=True):
            rows = np.arange(rows[0], rows[1])
            if len(rows) > 4 * self.k and len(np.unique(ids[rows])) == len(rows):
                # ties at the cut stay: the smaller id decides among them
                cut = np.partition(scores[rows], len(rows) - self.k)[len(rows) - self.k]
                rows = rows[scores[rows] >= cut]
            new = zip((-scores[rows]).tolist(), ids[rows].tolist(), strict=True)
            self.rows[q] = sorted({*self.rows[q], *new})[: self.k]
            if len(self.rows[q]) == self.k:
                self.floor[q] = -self.rows[q][-1][0]


def _runs(query: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    found, starts = np.unique(query, return_index=True)
    edges = [*starts.tolist(), len(query)]
    return found.tolist(), list(zip(edges[: len(found)], edges[1:], strict=True))


def search_block(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, best: _Best, levels=LEVELS
) -> None:
    """Adds the candidates x of every query q that can be among the k best."""
    if q.shape[1] == 0:
        query, cand = np.divmod(np.arange(len(q) * len(x)), len(x))
        keep = q_ids[query] != x_ids[cand]
        best.add(query[keep], x_ids[cand[keep]], np.zeros(int(keep.sum()), np.int64))
        return
    # rounding of the bounds: far below this share of the largest product
    slack = 1e-9 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1).max() + 1)
    bound = segment_features(q, levels[0]) @ segment_features(x, levels[0]).T + slack
    bound[q_ids[:, None] == x_ids[None, :]] = -np.inf
    # the k highest bounds of each query are compared first and give it a floor
    k = min(best.k, len(x))
    first = np.argpartition(-bound, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
    query, cand = np.repeat(np.arange(len(q)), first.shape[1]), first.ravel()
    fine = np.isfinite(bound[query, cand])
    query, cand = query[fine], cand[fine]
    best.add(query, x_ids[cand], _scores(q[query], x[cand]))
    floor = np.maximum(best.floor, -1e300)[:, None]
    for level in (*levels[1:], 0):
        # candidates that no query can use any more leave; so do queries without any
        alive = bound >= floor
        columns, rows = np.flatnonzero(alive.any(axis=0)), np.flatnonzero(alive.any(axis=1))
        bound, x, x_ids = bound[np.ix_(rows, columns)], x[columns], x_ids[columns]
        q, q_ids, slack, floor = q[rows], q_ids[rows], slack[rows], floor[rows]
        at = rows if level == levels[1] else at[rows]  # places of the queries left
        if not len(rows) or not level:
            break
        if level < q.shape[1]:
            finer = segment_features(q, level) @ segment_features(x, level).T + slack
            bound = np.minimum(bound, finer)
    if not len(q):
        return
    query, cand = np.nonzero(bound >= floor)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT and len(query) > 0.02 * bound.size:
        scores = (q @ x.T)[query, cand].astype(np.int64)  # exact: all sums are below 2^53
    else:
        parts = range(0, len(query), 1 << 16)
        found = [_scores(q[query[i : i + (1 << 16)]], x[cand[i : i + (1 << 16)]]) for i in parts]
        scores = np.concatenate([np.zeros(0, np.int64), *found])
    good = scores >= floor[query, 0]
    best.add(at[query[good]], x_ids[cand[good]], scores[good])


def _search(k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            q_ids = np.frombuffer(row.q_ids, np.int64)
            q = np.frombuffer(row.q_rows, np.float64).reshape(len(q_ids), row.dim)
            x_ids = np.frombuffer(row.ids, np.int64)
            x = np.frombuffer(row.rows, np.float64).reshape(len(x_ids), row.dim)
            best = _Best(len(q_ids), k)
            search_block(q, q_ids, x, x_ids, best)
            out = [
                (int(i), c, -s) for i, rows in zip(q_ids, best.rows, strict=True) for s, c in rows
            ]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """Each query's k highest inner products: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but
    those of the query's own id.  Ties go to the smaller id.  Vectors that are NULL
    or hold a NULL or non-finite component, and rows with a NULL id, take no part.
    Vectors meet only those of the same dimension; empty vectors score 0.  Repeated
    rows of one id are one candidate if they are equal (else each is).  Scores
    outside a long are cut to its range.  An empty table gives an empty table.
    Other columns are not read.
    """
    rows = slim(vectors, vec_id=vec_id, embedding=embedding).filter("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("v")
    ).filter("v IS NOT NULL")
    groups = max(1, -(-rows.count() // GROUP))
    keyed = rows.withColumn("key", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    # a group is one task: all its blocks are packed there, whatever the table's files look like
    candidates = keyed.repartition(groups, "key").mapInPandas(partial(_packed, BLOCK), _BLOCKS)
    queries = keyed.filter(F.col("vec_id") % every == 0)
    query_groups = max(1, groups // every + 1)
    queries = (
        queries.withColumn("key", F.pmod(F.xxhash64("vec_id"), F.lit(query_groups)).cast("int"))
        .repartition(query_groups, "key")
        .mapInPandas(partial(_packed, QUERY_BLOCK), _BLOCKS)
        .select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
        # the stated query set meets every group, block by block
        .withColumn("q_key", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    )
    meet = candidates.join(
        queries, (F.col("key") == F.col("q_key")) & (F.col("dim") == F.col("q_dim"))
    ).select("dim", "ids", "rows", "q_ids", "q_rows")
    found = meet.mapInPandas(partial(_search, k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # at most k rows a query from each block
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
