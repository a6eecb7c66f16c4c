"""Message rounds on a graph table with supplied weights, and the graph readout.

Incoming vectors are added up per edge kind before the linear map of that kind,
so the shuffle carries sums that combine on the map side, and the matrix work is
one batched product per node.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.session import checkpointed

LAYER_NORM_EPS = 1e-5


@dataclass(frozen=True)
class LayerWeights:
    """Weights of one round: square matrices and vectors of the hidden size."""

    own: np.ndarray
    own_bias: np.ndarray
    by_kind: Mapping[str, tuple[np.ndarray, np.ndarray]]
    gamma: np.ndarray
    beta: np.ndarray

    @property
    def size(self) -> int:
        return len(self.own_bias)


def initial_vectors(encoded: DataFrame, embedding: DataFrame) -> DataFrame:
    """Node vectors from a table (symbol_id, x): one row per symbol of the alphabet."""
    return encoded.join(F.broadcast(embedding), "symbol_id").select("graph_id", "node_id", "x")


def incoming_sums(vectors: DataFrame, edges: DataFrame, size: int, kinds: Sequence[str]) -> DataFrame:
    """(graph_id, node_id, counts, totals): per target, the number of messages of each kind
    and the sums of their source vectors, kind after kind.

    One grouping for all kinds, combined on the map side.
    """
    sent = edges.join(
        vectors.withColumnRenamed("node_id", "src"), ["graph_id", "src"]
    )
    of_kind = lambda k, value: F.when(F.col("kind") == k, value)
    zero = F.lit(0.0)
    sums = sent.groupBy("graph_id", F.col("dst").alias("node_id")).agg(
        *[F.count(of_kind(k, F.lit(1))).cast("double").alias(f"n{j}") for j, k in enumerate(kinds)],
        *[
            F.coalesce(F.sum(of_kind(k, F.get("x", F.lit(i)))), zero).alias(f"s{j}_{i}")
            for j, k in enumerate(kinds) for i in range(size)
        ],
    )
    return sums.select(
        "graph_id", "node_id",
        F.array(*[f"n{j}" for j in range(len(kinds))]).alias("counts"),
        F.array(*[f"s{j}_{i}" for j in range(len(kinds)) for i in range(size)]).alias("totals"),
    )


def message_round(
    vectors: DataFrame, edges: DataFrame, weights: LayerWeights
) -> DataFrame:
    """Own transform plus incoming messages, layer norm, ReLU."""
    kinds = list(weights.by_kind)
    used = edges.filter(F.col("kind").isin(*kinds))
    joined = vectors.join(incoming_sums(vectors, used, weights.size, kinds), ["graph_id", "node_id"], "left")
    update = _update(weights, kinds)
    counts = F.coalesce("counts", F.array_repeat(F.lit(0.0), len(kinds)))
    totals = F.coalesce("totals", F.array_repeat(F.lit(0.0), len(kinds) * weights.size))
    return joined.select("graph_id", "node_id", update("x", counts, totals).alias("x"))


def _update(weights: LayerWeights, kinds: Sequence[str]):
    size = weights.size
    maps = [weights.by_kind[k] for k in kinds]

    @F.pandas_udf("array<double>")
    def update(x: pd.Series, counts: pd.Series, totals: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        own = np.stack(x.to_numpy())
        number = np.stack(counts.to_numpy())
        total = np.stack(totals.to_numpy()).reshape(len(own), len(maps), size)
        out = own @ weights.own.T + weights.own_bias
        for i, (matrix, bias) in enumerate(maps):
            out += total[:, i] @ matrix.T + number[:, i, None] * bias
        centred = out - out.mean(axis=1, keepdims=True)
        scale = np.sqrt((centred**2).mean(axis=1, keepdims=True) + LAYER_NORM_EPS)
        return pd.Series(list(np.maximum(centred / scale * weights.gamma + weights.beta, 0.0)))

    return update


def message_passing(
    vectors: DataFrame, edges: DataFrame, layers: Sequence[LayerWeights]
) -> DataFrame:
    """All rounds; lineage is cut after each but the last."""
    for i, layer in enumerate(layers):
        vectors = message_round(vectors, edges, layer)
        if i + 1 < len(layers):
            vectors = checkpointed(vectors)
    return vectors


def readout(vectors: DataFrame, size: int, pooling: str = "mean") -> DataFrame:
    """(graph_id, pooled): mean of the node vectors, or the mean followed by the maximum."""
    if pooling not in ("mean", "meanmax"):
        raise ValueError(f"unknown pooling {pooling!r}")
    value = [F.get("x", F.lit(i)) for i in range(size)]
    aggregates = [F.avg(v).alias(f"m{i}") for i, v in enumerate(value)]
    names = [f"m{i}" for i in range(size)]
    if pooling == "meanmax":
        aggregates += [F.max(v).alias(f"t{i}") for i, v in enumerate(value)]
        names += [f"t{i}" for i in range(size)]
    pooled = vectors.groupBy("graph_id").agg(*aggregates)
    return pooled.select("graph_id", F.array(*names).alias("pooled"))


def linear_head(pooled: Column, matrix: np.ndarray, bias: np.ndarray) -> Column:
    """Raw scores of a linear head over the pooled vector."""

    def score(row: np.ndarray, b: float) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in row])
        products = F.zip_with(pooled, weights, lambda a, w: a * w)
        return F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + F.lit(float(b))

    return F.array(*[score(r, b) for r, b in zip(matrix, bias, strict=True)])
