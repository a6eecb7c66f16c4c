"""Ordered class lists: ranks, distances and the mapping of richer to plainer classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered class names and the rounding of the extended list.
TIME_CLASSES = (
    "O(1)", "O(log n)", "O(n)", "O(n log n)", "O(n^2)", "O(n^3)", "O(2^n)",
)
SPACE_CLASSES = ("O(1)", "O(log n)", "O(n)", "O(n log n)", "O(n^2)")
EXTENDED_TIME_CLASSES = (
    "O(1)", "O(log n)", "O(sqrt n)", "O(n)", "O(n log n)",
    "O(n^2)", "O(n^2 log n)", "O(n^3)", "O(2^n)", "O(n!)",
)
LEGACY_OF_EXTENDED = {
    "O(1)": "O(1)",
    "O(log n)": "O(log n)",
    "O(sqrt n)": "O(n)",
    "O(n)": "O(n)",
    "O(n log n)": "O(n log n)",
    "O(n^2)": "O(n^2)",
    "O(n^2 log n)": "O(n^3)",
    "O(n^3)": "O(n^3)",
    "O(2^n)": "O(2^n)",
    "O(n!)": "O(2^n)",
}
# Label spellings of the two public corpora.
TIME_LABELS = {
    "canonical": {c: c for c in TIME_CLASSES},
    "bigobench": {
        "O(1)": "O(1)", "O(logn)": "O(log n)", "O(n)": "O(n)", "O(nlogn)": "O(n log n)",
        "O(n**2)": "O(n^2)", "O(n**3)": "O(n^3)", "O(2**n)": "O(2^n)",
    },
    "codecomplex": {
        "constant": "O(1)", "logn": "O(log n)", "linear": "O(n)", "nlogn": "O(n log n)",
        "quadratic": "O(n^2)", "cubic": "O(n^3)", "np": "O(2^n)", "exponential": "O(2^n)",
    },
}
SPACE_LABELS = {
    "canonical": {c: c for c in SPACE_CLASSES},
    "bigobench": {
        "O(1)": "O(1)", "O(logn)": "O(log n)", "O(n)": "O(n)", "O(nlogn)": "O(n log n)",
        "O(n**2)": "O(n^2)",
    },
}


def literal_map(pairs: Mapping[str, object]) -> Column:
    """A constant map column; folded once by Catalyst."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def class_array(classes: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def rank_of(label: Column, classes: Sequence[str]) -> Column:
    """Zero-based rank in declaration order; NULL for NULL or an unknown class."""
    place = F.array_position(class_array(classes), label)
    return F.when(place > 0, (place - 1).cast("int"))


def class_at(rank: Column, classes: Sequence[str]) -> Column:
    return F.element_at(class_array(classes), rank.cast("int") + 1)


def ordinal_distance(a: Column, b: Column, classes: Sequence[str]) -> Column:
    return F.abs(rank_of(a, classes) - rank_of(b, classes))


def rounded_class(label: Column, table: Mapping[str, str] = LEGACY_OF_EXTENDED) -> Column:
    """The plainer class an extended one is reported as."""
    return F.element_at(literal_map(table), label)
