"""Every growth shape is recovered from exact costs; cost terms round up."""

import math

import pytest
from pyspark.sql import functions as F

from rankwell.functions.growth import TIME_SHAPES, curve_value, size_grid
from rankwell.operators import growth

SHAPE = {
    "const": lambda n: 1, "log": lambda n: math.log(n), "linear": lambda n: n,
    "linearithmic": lambda n: n * math.log(n), "quadratic": lambda n: n**2,
    "cubic": lambda n: n**3, "exponential": lambda n: 2**n,
}


def test_every_shape_is_recovered(spark):
    rows = []
    for shape, f in SHAPE.items():
        sizes = range(8, 19, 2) if shape == "exponential" else (64, 256, 1024, 4096, 16384, 65536)
        rows += [(shape, n, float(1000 * f(n))) for n in sizes]
    samples = spark.createDataFrame(rows, "series string, n long, time_ns double")
    fits = growth.fit_shapes(
        growth.median_costs(samples, ["time_ns"]), {"time_ns": tuple(TIME_SHAPES)}
    )
    best = growth.best_fits(fits)
    assert {r.series: r.best for r in best.collect()} == {s: s for s in SHAPE}
    classes = growth.classify_growth(best, "time_ns", ["peak_bytes"]).collect()
    assert {r.series: r.time_class for r in classes} == TIME_SHAPES


def test_one_size_cannot_be_fitted(spark):
    samples = spark.createDataFrame([("a", 8, 1.0), ("a", 8, 3.0)], "series string, n long, t double")
    medians = growth.median_costs(samples, ["t"])
    assert medians.first()["median"] == 2.0
    assert growth.insufficient_series(medians).count() == 1
    assert growth.fit_shapes(medians, {"t": ("const", "linear")}).count() == 0
    with pytest.raises(Exception, match="fewer than two sizes"):
        growth.fit_shapes(medians, {"t": ("const", "linear")}, strict=True).collect()


def test_curve_caps(spark):
    grid = size_grid()
    assert grid[0] == 8 and grid[-1] == 65536 and len(grid) == 12
    row = spark.range(1).select(
        curve_value(F.lit("O(2^n)"), F.lit(65536)).alias("a"),
        curve_value(F.lit("O(n!)"), F.lit(8)).alias("b"),
        curve_value(F.lit("O(n!)"), F.lit(21)).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (2.0**64, 40320.0, 2.0**64)


@pytest.mark.parametrize(("term", "time", "extended", "space"), [
    ((0, 0, 0, 0, False), ("O(1)", False), ("O(1)", False), ("O(1)", False)),
    ((0, 0, 0.5, 0, False), ("O(n)", True), ("O(sqrt n)", False), ("O(n)", True)),
    ((0, 0, 2, 1, False), ("O(n^3)", True), ("O(n^2 log n)", False), ("O(n^2)", True)),
    ((0, 0, 1, 1, False), ("O(n log n)", False), ("O(n log n)", False), ("O(n log n)", False)),
    ((0, 2, 0, 0, False), ("O(2^n)", False), ("O(2^n)", False), ("O(n^2)", True)),
    ((1, 0, 0, 0, False), ("O(2^n)", True), ("O(n!)", False), ("O(n^2)", True)),
    ((0, 0, 4, 0, False), ("O(n^3)", True), ("O(n^3)", True), ("O(n^2)", True)),
    ((0, 0, 0, 2, False), ("O(n)", True), ("O(n)", True), ("O(n)", True)),
])
def test_projection(spark, term, time, extended, space):
    frame = spark.createDataFrame(
        [tuple(map(float, term[:4])) + (term[4],)],
        "facts double, base double, power double, log double, extras boolean",
    )
    row = frame.select(growth.project_time(), growth.project_time_extended(), growth.project_space()).first()
    assert [tuple(c) for c in row] == [time, extended, space]
