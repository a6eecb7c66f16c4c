"""Growth shapes: log bases for fitting, and the textbook curves of the classes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Candidate shapes and the class each one stands for.
TIME_SHAPES = {
    "const": "O(1)", "log": "O(log n)", "linear": "O(n)", "linearithmic": "O(n log n)",
    "quadratic": "O(n^2)", "cubic": "O(n^3)", "exponential": "O(2^n)",
}
SPACE_SHAPES = {k: TIME_SHAPES[k] for k in ("const", "log", "linear", "linearithmic", "quadratic")}
# Fixed values of the curve: smallest and largest n, points, and the cap of 2^n and n!.
N_MIN, N_MAX, N_POINTS = 8, 65_536, 12
CAP = 2.0**64


def log_basis(shape: str, n: Column) -> Column:
    """Natural log of a shape at n, for n of at least 2."""
    ln = F.ln(n.cast("double"))
    return {
        "const": F.lit(0.0),
        "log": F.ln(ln),
        "linear": ln,
        "linearithmic": ln + F.ln(ln),
        "quadratic": 2 * ln,
        "cubic": 3 * ln,
        "exponential": n * math.log(2),
    }[shape]


def size_grid(low: int = N_MIN, high: int = N_MAX, points: int = N_POINTS) -> list[int]:
    """Geometric grid of input sizes, rounded to whole numbers."""
    a, b = math.log2(low), math.log2(high)
    return [round(2 ** (a + i * (b - a) / (points - 1))) for i in range(points)]


def curve_value(name: Column, n: Column) -> Column:
    """Value of a class at n; 2^n and n! are capped at 2^64."""
    x = n.cast("double")
    log = F.log2(x)
    cap = F.lit(CAP)
    return (
        F.when(name == "O(1)", F.lit(1.0))
        .when(name == "O(log n)", log)
        .when(name == "O(sqrt n)", F.sqrt(x))
        .when(name == "O(n)", x)
        .when(name == "O(n log n)", x * log)
        .when(name == "O(n^2)", x * x)
        .when(name == "O(n^2 log n)", x * x * log)
        .when(name == "O(n^3)", x * x * x)
        .when(name == "O(2^n)", F.least(F.pow(F.lit(2.0), x), cap))
        .when(
            name == "O(n!)",
            F.when(n <= 20, F.factorial(F.least(n, F.lit(20))).cast("double")).otherwise(cap),
        )
        .otherwise(F.raise_error(F.concat(F.lit("unknown class: "), name)))
    )
