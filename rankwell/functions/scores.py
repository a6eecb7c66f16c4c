"""Per-row work on score vectors: softmax, argmax, intervals of mass, ordinal loss.

Everything is a higher-order function over one array, so no row is multiplied
and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.functions.ordinal import class_array


def bind(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), step), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(scores: Column, temperature: float | Column = 1.0) -> Column:
    """Tempered softmax, shifted by the maximum."""
    scaled = F.transform(scores, lambda x: x / temperature)
    powers = bind(scaled, lambda s: bind(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp(x - m))))
    return bind(powers, lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax(scores: Column) -> Column:
    def shifted(s: Column) -> Column:
        top = F.array_max(s)
        return bind(
            top + F.ln(total(F.transform(s, lambda x: F.exp(x - top)))),
            lambda z: F.transform(s, lambda x: x - z),
        )

    return bind(scores, shifted)


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _grow(proba: Column, state: Column) -> Column:
    """One step outward to the heavier neighbour; the lower rank on ties."""
    left = F.coalesce(F.get(proba, state["lo"] - 1), F.lit(-1.0))
    right = F.coalesce(F.get(proba, state["hi"] + 1), F.lit(-1.0))
    down = left >= right
    return F.struct(
        F.when(down, state["lo"] - 1).otherwise(state["lo"]).alias("lo"),
        F.when(down, state["hi"]).otherwise(state["hi"] + 1).alias("hi"),
        (state["mass"] + F.when(down, left).otherwise(right)).alias("mass"),
    )


def _grown(proba: Column, classes: int, stop: Callable[[Column], Column]) -> Column:
    def run(p: Column) -> Column:
        point = argmax(p)
        start = F.struct(point.alias("lo"), point.alias("hi"), F.array_max(p).alias("mass"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(classes - 1)),
            start,
            lambda s, _: F.when(
                stop(s) | ((s["lo"] == 0) & (s["hi"] == classes - 1)), s
            ).otherwise(_grow(p, s)),
        )

    return bind(proba, run)


def mass_to_include(proba: Column, true_rank: Column, classes: int) -> Column:
    """Mass of the grown interval once it reaches the true rank."""
    reached = lambda s: (s["lo"] <= true_rank) & (true_rank <= s["hi"])
    return _grown(proba, classes, reached)["mass"]


def prediction_set(proba: Column, threshold: Column, classes: Sequence[str]) -> Column:
    """Contiguous classes around the argmax whose mass reaches the threshold."""
    grown = _grown(proba, len(classes), lambda s: s["mass"] >= threshold)
    return bind(
        grown, lambda g: F.slice(class_array(classes), g["lo"] + 1, g["hi"] - g["lo"] + 1)
    )


def even_spread(answer: Column, confidence: Column, classes: Sequence[str]) -> Column:
    """Map class -> probability: the confidence on the answer, the rest spread evenly."""
    names = class_array(classes)
    sure = F.round(confidence, 4)
    rest = F.round((1.0 - sure) / (len(classes) - 1), 4)
    return F.map_from_arrays(
        names, F.transform(names, lambda c: F.when(c == answer, sure).otherwise(rest))
    )


def ordinal_loss(scores: Column, true_rank: Column, tau: float = 1.0) -> Column:
    """Cross-entropy against soft targets that fall off with the rank gap."""
    weights = F.transform(scores, lambda x, i: F.exp(-F.abs(i - true_rank) / tau))

    def loss(w: Column) -> Column:
        pairs = F.zip_with(w, log_softmax(scores), lambda a, b: a * b)
        return -total(pairs) / total(w)

    return bind(weights, loss)


def right_closed_bin(confidence: Column, bins: int = 10) -> Column:
    """Bin of ``(low, high]``; the first one includes 0.  Edges are the evenly spaced doubles."""
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0.0, 1.0, bins + 1)[:-1]])
    return F.greatest(F.size(F.filter(edges, lambda e: confidence > e)) - 1, F.lit(0))


def left_closed_bin(confidence: Column, bins: int = 10) -> Column:
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
