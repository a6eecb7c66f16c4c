"""Registered queries: growth-shape fits, classes, curves and cost terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.growth import SPACE_SHAPES, TIME_SHAPES, log_basis, size_grid
from rankwell.functions.ordinal import EXTENDED_TIME_CLASSES, class_at
from rankwell.operators import growth
from rankwell.plans.adapters import samples, table, with_views
from rankwell.plans.catalog import query
from rankwell.plans.judging_queries import rounded

SHAPES = {
    "time_ns": tuple(TIME_SHAPES),
    "peak_bytes": tuple(SPACE_SHAPES),
    "max_call_depth": tuple(SPACE_SHAPES),
}
_BASIS = {
    "const": "0.0::DOUBLE", "log": "ln(ln(n))", "linear": "ln(n)", "linearithmic": "ln(n) + ln(ln(n))",
    "quadratic": "2 * ln(n)", "cubic": "3 * ln(n)", "exponential": "n * ln(2)",
}


@query("shape_log_basis", "X6", sql=with_views(
    "SELECT DISTINCT series, n, " + ", ".join(f"round({b}, 6) AS {s}" for s, b in _BASIS.items())
    + " FROM samples", "samples"))
def _basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = growth.valid_sizes(samples(spark, sf_dir)).select("series", "n").distinct()
    return sizes.select(
        "series", "n",
        *[F.round(log_basis(s, F.col("n")), 6).alias(s) for s in TIME_SHAPES],
    )


_LONG = """long AS (
  SELECT series, 'time_ns' AS cost, n, median(time_ns) AS med FROM samples GROUP BY 1, 3
  UNION ALL SELECT series, 'peak_bytes', n, median(peak_bytes) FROM samples GROUP BY 1, 3
  UNION ALL SELECT series, 'max_call_depth', n, median(max_call_depth) FROM samples
    WHERE max_call_depth IS NOT NULL GROUP BY 1, 3)"""
_FITS = f"""{_LONG}, lc AS (SELECT *, ln(greatest(med, 1.0)) AS lc FROM long),
  shapes AS (SELECT * FROM (VALUES {', '.join(
      f"('{s}', {i})" for i, s in enumerate(TIME_SHAPES))}) t(shape, position)),
  r AS (SELECT series, cost, shape, position, lc, lc - CASE shape {' '.join(
      f"WHEN '{s}' THEN {b}" for s, b in _BASIS.items())} END AS res
    FROM lc, shapes WHERE cost = 'time_ns' OR position < 5),
  f AS (SELECT series, cost, shape, position, count(*) AS m, avg(res) AS log_scale,
      var_pop(res) * count(*) AS rss, var_pop(lc) * count(*) AS tss FROM r GROUP BY ALL),
  g AS (SELECT *, CASE WHEN rss = 0 THEN 1.0 WHEN tss > 0 THEN 1 - rss / tss ELSE 0.0 END AS r2,
      m * ln(greatest(rss, 1e-12) / m) + ln(m) AS bic FROM f WHERE m >= 2),
  fits AS (SELECT *, row_number() OVER (PARTITION BY series, cost ORDER BY bic, position) AS rank,
      exp(-0.5 * (bic - min(bic) OVER (PARTITION BY series, cost))) AS w FROM g)"""


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = growth.median_costs(samples(spark, sf_dir), list(SHAPES))
    return growth.fit_shapes(medians, SHAPES)


@query("median_costs", "D25", sql=with_views(
    f"{_LONG} SELECT series, cost, n, med AS median FROM long", "samples"))
def _medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.median_costs(samples(spark, sf_dir), list(SHAPES))


@query("growth_shape_fit", "D25", "X6", sql=with_views(
    f"""{_FITS} SELECT series, cost, shape, round(log_scale, 6) AS log_scale,
      round(r2, 6) AS r_squared, round(bic, 6) AS bic, rank::INT AS rank,
      round(w / sum(w) OVER (PARTITION BY series, cost), 6) AS weight FROM fits""", "samples"))
def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits(spark, sf_dir), "log_scale", "r_squared", "bic", "weight")


@query("growth_candidate_ranking", "F5", sql=with_views(
    f"""{_FITS} SELECT series, cost, max(shape) FILTER (rank = 1) AS best,
      round(max(r2) FILTER (rank = 1), 6) AS r_squared,
      round(max(w) FILTER (rank = 1) / sum(w), 6) AS confidence,
      max(shape) FILTER (rank = 2) AS runner_up FROM fits GROUP BY 1, 2""", "samples"))
def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(growth.best_fits(fits(spark, sf_dir)), "r_squared", "confidence")


def _class_sql(shapes: dict[str, str]) -> str:
    return "CASE shape " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in shapes.items()) + " END"


@query("growth_classification", "D26", sql=with_views(
    f"""{_FITS}, b AS (SELECT series, cost, shape, position, r2,
        w / sum(w) OVER (PARTITION BY series, cost) AS conf, rank FROM fits),
    ok AS (SELECT * FROM b WHERE rank = 1 AND r2 >= 0.02)
    SELECT s.series,
      max({_class_sql(TIME_SHAPES)}) FILTER (cost = 'time_ns') AS time_class,
      round(max(conf) FILTER (cost = 'time_ns'), 6) AS time_confidence,
      arg_max({_class_sql(SPACE_SHAPES)}, (position, cost = 'peak_bytes'))
        FILTER (cost <> 'time_ns') AS space_class,
      round(arg_max(conf, (position, cost = 'peak_bytes')) FILTER (cost <> 'time_ns'), 6)
        AS space_confidence
    FROM (SELECT DISTINCT series FROM fits) s LEFT JOIN ok ON s.series = ok.series
    GROUP BY s.series""", "samples"))
def _classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    # prices hardly follow the quantity here, so a low floor lets both outcomes occur
    best = growth.best_fits(fits(spark, sf_dir))
    classes = growth.classify_growth(
        best, "time_ns", ["peak_bytes", "max_call_depth"], floor=0.02
    )
    return rounded(classes, "time_confidence", "space_confidence")


_VALUE = """CASE series_class WHEN 'O(1)' THEN 1 WHEN 'O(log n)' THEN log2(n)
  WHEN 'O(sqrt n)' THEN sqrt(n) WHEN 'O(n)' THEN n WHEN 'O(n log n)' THEN n * log2(n)
  WHEN 'O(n^2)' THEN n * n WHEN 'O(n^2 log n)' THEN n * n * log2(n) WHEN 'O(n^3)' THEN n * n * n
  WHEN 'O(2^n)' THEN CASE WHEN n < 64 THEN pow(2, n) ELSE pow(2, 64) END
  WHEN 'O(n!)' THEN CASE WHEN n <= 20 THEN factorial(n::INT)::DOUBLE ELSE pow(2, 64) END END"""
_EXT = list(EXTENDED_TIME_CLASSES)


@query("growth_curve", "X5", sql=f"""
  WITH p AS (SELECT {_EXT}[least(floor(o_totalprice / 50000)::INT, 9) + 1] AS predicted_class,
      count(*) AS answers FROM orders GROUP BY 1),
  k AS (SELECT *, list_position({_EXT}, predicted_class) AS place FROM p),
  s AS (SELECT predicted_class, answers, {_EXT}[(place + d)::INT] AS series_class FROM k,
      (VALUES (-1), (0), (1)) t(d) WHERE place + d BETWEEN 1 AND 10)
  SELECT predicted_class, answers, series_class, n::INT AS n, round({_VALUE}, 4) AS value
  FROM s, (SELECT unnest({size_grid()})::DOUBLE AS n)""")
def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.least(F.floor(F.col("o_totalprice") / 50000), F.lit(9))
    predicted = (
        table(spark, sf_dir, "orders")
        .groupBy(class_at(band, EXTENDED_TIME_CLASSES).alias("predicted_class"))
        .agg(F.count(F.lit(1)).alias("answers"))
    )
    curves = growth.growth_curves(predicted, "predicted_class", EXTENDED_TIME_CLASSES)
    return curves.withColumn("value", F.round("value", 4))


def cost_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as variables of terms: order = expression, line number = term."""
    quantity = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("expression"),
        F.col("l_linenumber").alias("term"),
        F.round(F.col("l_discount") * 100).cast("int").alias("coef"),
        (F.when(quantity < 40, quantity % 3).otherwise(quantity % 5).cast("decimal(9,4)") / 2)
        .cast("decimal(9,4)").alias("power"),
        F.when(F.col("l_tax") < 0.03, 0).otherwise(F.col("l_suppkey") % 2).cast("int").alias("log"),
        F.when(F.col("l_partkey") % 90 == 0, 2).when(F.col("l_partkey") % 90 == 1, 3)
        .otherwise(0).alias("base"),
        (F.col("l_partkey") % 190 == 5).alias("is_fact"),
    )


_TERMS = """v AS (SELECT l_orderkey AS e, l_linenumber AS t,
    CASE WHEN l_quantity < 40 THEN l_quantity::INT % 3 ELSE l_quantity::INT % 5 END / 2 AS power,
    CASE WHEN l_tax < 0.03 THEN 0 ELSE l_suppkey % 2 END AS log,
    CASE l_partkey % 90 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS base,
    l_partkey % 190 = 5 AS is_fact FROM lineitem WHERE round(l_discount * 100) > 0),
  c AS (SELECT e, t, sum(is_fact::INT) AS facts, max(base) AS base, sum(power) AS power,
    sum(log) AS log, bool_or(power <> 0 OR log <> 0) AND bool_or(base > 0 OR is_fact) AS extras
    FROM v GROUP BY e, t),
  d AS (SELECT e, max((facts, base, power, log, extras)) AS m FROM c GROUP BY e),
  p AS (SELECT o_orderkey AS expression, coalesce(m[1], 0) AS facts, coalesce(m[2], 0) AS base,
    coalesce(m[3], 0) AS power, coalesce(m[4], 0) AS log, coalesce(m[5], false) AS extras
    FROM orders LEFT JOIN d ON o_orderkey = e)"""
_CLASSES = """k(scale, pos, class, kind, a, b) AS (VALUES
    ('t', 1, 'O(1)', 0, 0.0, 0.0), ('t', 2, 'O(log n)', 0, 0.0, 1.0), ('t', 3, 'O(n)', 0, 1.0, 0.0),
    ('t', 4, 'O(n log n)', 0, 1.0, 1.0), ('t', 5, 'O(n^2)', 0, 2.0, 0.0),
    ('t', 6, 'O(n^3)', 0, 3.0, 0.0), ('t', 7, 'O(2^n)', 1, 2.0, 0.0),
    ('s', 1, 'O(1)', 0, 0.0, 0.0), ('s', 2, 'O(log n)', 0, 0.0, 1.0), ('s', 3, 'O(n)', 0, 1.0, 0.0),
    ('s', 4, 'O(n log n)', 0, 1.0, 1.0), ('s', 5, 'O(n^2)', 0, 2.0, 0.0)),
  z AS (SELECT *, CASE WHEN facts > 0 THEN 2 WHEN base > 0 THEN 1 ELSE 0 END AS kind,
    CASE WHEN facts > 0 THEN facts WHEN base > 0 THEN base ELSE power END::DOUBLE AS a,
    CASE WHEN facts > 0 OR base > 0 THEN 0 ELSE log END::DOUBLE AS b FROM p),
  r AS (SELECT z.expression, k.scale, k.class, k.pos,
      k.kind = z.kind AS akin, (k.a > z.a OR k.a = z.a AND k.b >= z.b) AND k.kind = z.kind AS enough,
      k.kind <> z.kind OR k.a <> z.a OR k.b <> z.b OR extras AS off FROM z, k),
  f AS (SELECT *, row_number() OVER (PARTITION BY expression, scale ORDER BY enough DESC,
      CASE WHEN enough THEN pos END, akin DESC, pos DESC) AS place FROM r),
  u AS (SELECT expression, max(class) FILTER (scale = 't') AS tc, bool_or(off) FILTER (scale = 't') AS tl,
      max(class) FILTER (scale = 's') AS sc, bool_or(off) FILTER (scale = 's') AS sl
    FROM f WHERE place = 1 GROUP BY 1)"""


@query("dominant_term_projection", "P18", sql=f"""
  WITH {_TERMS}, {_CLASSES}
  SELECT expression, tc AS time_class, tl AS time_lossy,
    CASE WHEN kind = 2 THEN 'O(n!)' WHEN kind = 0 AND a = 2 AND b = 1 THEN 'O(n^2 log n)'
      WHEN kind = 0 AND a = 0.5 AND b = 0 THEN 'O(sqrt n)' ELSE tc END AS extended_class,
    CASE WHEN kind = 2 THEN a <> 1 OR extras
      WHEN kind = 0 AND (a = 2 AND b = 1 OR a = 0.5 AND b = 0) THEN false
      ELSE tl END AS extended_lossy,
    sc AS space_class, sl AS space_lossy FROM z JOIN u USING (expression)""")
def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    expressions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("expression"))
    return growth.project_terms(expressions, cost_terms(spark, sf_dir), "expression", "term")
