"""Registered queries: softmax, temperature, calibration errors and conformal sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions import scores as sc
from rankwell.functions.stats import laplace
from rankwell.operators import judge, uncertain
from rankwell.plans.adapters import SCORE_CLASSES, SEGMENTS, answers_wide, scores, with_views
from rankwell.plans.catalog import query
from rankwell.plans.judging_queries import rounded

T0 = 1.3


def proba(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    frame = scores(spark, sf_dir)
    if split:
        frame = frame.filter(F.col("split") == split)
    return uncertain.with_prediction(uncertain.with_probabilities(frame, T0), SCORE_CLASSES)


_PROBA = f"""e AS (SELECT *, list_transform(scores, lambda x: exp(x / {T0} - list_max(scores) / {T0}))
    AS pw FROM scores),
  proba AS (SELECT id, true_label, true_rank, split,
    list_transform(pw, lambda x: x / list_sum(pw)) AS p, list_max(pw) / list_sum(pw) AS confidence,
    list_position(scores, list_max(scores)) - 1 AS point FROM e)"""


@query("tempered_softmax", "X4", sql=with_views(
    f"""{_PROBA} SELECT id, {', '.join(f'round(p[{i + 1}], 6) AS p{i}' for i in range(10))}
    FROM proba""", "scores"))
def _softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proba(spark, sf_dir).select(
        "id", *[F.round(F.get("proba", F.lit(i)), 6).alias(f"p{i}") for i in range(10)]
    )


@query("argmax_prediction", "F4", sql=with_views(
    f"""{_PROBA} SELECT id, 'c' || point AS answer, round(confidence, 6) AS confidence
    FROM proba""", "scores"))
def _argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proba(spark, sf_dir).select("id", "answer", "confidence"), "confidence")


def _temperature_sql() -> str:
    """The grid search, one CTE per round."""
    grid = [repr(float(t)) for t in np.linspace(0.05, 10.0, 200)]
    nll = """(SELECT t, avg(-ln(greatest(1e-12, exp(scores[true_rank + 1] / t - list_max(scores) / t)
      / list_sum(list_transform(scores, lambda x: exp(x / t - list_max(scores) / t)))))) AS loss
      FROM v CROSS JOIN {grid} GROUP BY t)"""
    parts = [
        "v AS (SELECT scores, true_rank FROM scores WHERE split = 'val')",
        f"g0 AS (SELECT unnest([{', '.join(grid)}]::DOUBLE[]) AS t)",
        f"b0 AS (SELECT arg_min(t, (loss, t)) AS t, min(loss) AS loss FROM {nll.format(grid='g0')})",
    ]
    step = (10.0 - 0.05) / 200
    for i in range(1, 7):
        step /= 4
        low = f"greatest(b{i - 1}.t - {2 * step!r}, 1e-3)"
        high = f"(b{i - 1}.t + {2 * step!r})"
        parts.append(
            f"g{i} AS (SELECT {low} + ({high} - {low}) / 8 * k AS t FROM b{i - 1}, range(9) r(k))"
        )
        parts.append(
            f"b{i} AS (SELECT arg_min(t, (loss, t)) AS t, min(loss) AS loss"
            f" FROM {nll.format(grid=f'g{i}')})"
        )
    body = ",\n".join(parts)
    return with_views(
        f"{body} SELECT round(t, 3) AS temperature, round(loss, 6) AS loss FROM b6", "scores"
    )


@query("temperature_fit", "M7", sql=_temperature_sql())
def _temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = scores(spark, sf_dir).filter(F.col("split") == "val")
    temperature, loss = uncertain.fit_temperature(val)
    return spark.createDataFrame(
        [(round(temperature, 3), round(loss, 6))], "temperature double, loss double"
    )


@query("ece_right_closed", "D11", sql=with_views(
    f"""{_PROBA}, b AS (SELECT split, greatest(len(list_filter([{', '.join(
        repr(float(e)) for e in np.linspace(0, 1, 11)[:-1])}]::DOUBLE[],
        lambda e: confidence > e)) - 1, 0) AS bin, confidence, ('c' || point) = true_label AS ok
      FROM proba), g AS (SELECT split, bin, count(*) AS n, avg(ok::INT) AS a, avg(confidence) AS c
      FROM b GROUP BY 1, 2)
    SELECT split, sum(n)::BIGINT AS n, round(sum(n * abs(a - c)) / sum(n), 6) AS ece
    FROM g GROUP BY split""", "scores"))
def _ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = proba(spark, sf_dir).withColumn("correct", F.col("answer") == F.col("true_label"))
    return rounded(uncertain.expected_calibration_error(frame, ["split"]), "ece")


# --------------------------------------------------------------------------- conformal
_GROW = f"""{_PROBA},
  walk AS (SELECT id, split, true_label, true_rank, p, point AS lo, point AS hi, p[point + 1] AS mass,
      0 AS step FROM proba
    UNION ALL
    SELECT id, split, true_label, true_rank, p,
      CASE WHEN down THEN lo - 1 ELSE lo END, CASE WHEN down THEN hi ELSE hi + 1 END,
      mass + CASE WHEN down THEN p[lo] ELSE p[hi + 2] END, step + 1
    FROM (SELECT *, lo > 0 AND (hi = 9 OR p[lo] >= p[hi + 2]) AS down FROM walk)
    WHERE lo > 0 OR hi < 9),
  mass AS (SELECT id, split, min(mass) AS mass FROM walk
    WHERE lo <= true_rank AND true_rank <= hi GROUP BY 1, 2),
  ranked AS (SELECT mass, row_number() OVER (ORDER BY mass) AS r, count(*) OVER () AS n FROM mass
    WHERE split = 'val'),
  alphas AS (SELECT * FROM (VALUES (0.05::DOUBLE, {1 - 0.05!r}::DOUBLE),
    (0.1::DOUBLE, {1 - 0.10!r}::DOUBLE), (0.2::DOUBLE, {1 - 0.20!r}::DOUBLE)) t(alpha, keep)),
  cut AS (SELECT alpha, max(mass) AS threshold, max(n) AS n FROM alphas, ranked
    WHERE r = ceil(least(1.0, ceil((n + 1) * keep) / n) * (n - 1)) + 1 GROUP BY alpha),
  sets AS (SELECT alpha, id, split, true_label, true_rank, arg_min(lo, step) AS lo,
      arg_min(hi, step) AS hi FROM walk, cut
    WHERE mass >= threshold OR (lo = 0 AND hi = 9) GROUP BY ALL)"""


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncertain.fit_conformal(proba(spark, sf_dir, "val"), SCORE_CLASSES)


@query("conformal_fit", "M8", sql=with_views(
    f"""{_GROW} SELECT n, round(max(threshold) FILTER (alpha = 0.05), 6) AS t05,
      round(max(threshold) FILTER (alpha = 0.1), 6) AS t10,
      round(max(threshold) FILTER (alpha = 0.2), 6) AS t20 FROM cut GROUP BY n""", "scores"))
def _conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.col("mass_threshold_by_alpha")
    return thresholds(spark, sf_dir).select(
        "n",
        *[F.round(cut[k], 6).alias(f"t{k[2:]}") for k in ("0.05", "0.10", "0.20")],
    )


@query("conformal_sets", "M9", "P17", sql=with_views(
    f"""{_GROW} SELECT id, 'c' || lo AS first_class, 'c' || hi AS last_class,
      (hi - lo + 1)::INT AS set_size, hi - lo + 1 >= 4 AS abstain FROM sets
    WHERE alpha = 0.1 AND split = 'test'""", "scores"))
def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = uncertain.with_prediction_set(
        proba(spark, sf_dir, "test"), thresholds(spark, sf_dir), SCORE_CLASSES
    )
    return frame.select(
        "id",
        F.element_at("conformal_set", 1).alias("first_class"),
        F.element_at("conformal_set", -1).alias("last_class"),
        "set_size", "abstain",
    )


@query("risk_coverage_table", "M10", sql=with_views(
    f"""{_GROW} SELECT alpha, count(*) AS n,
      round(avg((lo <= true_rank AND true_rank <= hi)::INT), 4) AS empirical_coverage,
      round(avg(hi - lo + 1), 4) AS average_set_size FROM sets WHERE split = 'test'
    GROUP BY alpha""", "scores"))
def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = uncertain.risk_coverage(
        proba(spark, sf_dir, "test"), thresholds(spark, sf_dir), SCORE_CLASSES
    )
    return table.withColumns(
        {c: F.round(c, 4) for c in ("empirical_coverage", "average_set_size")}
    )


@query("calibration_summary", "D12", sql=with_views(
    f"""{_GROW}, a AS (SELECT p.confidence, ('c' || point) = p.true_label AS ok,
        lo <= p.true_rank AND p.true_rank <= hi AS covered, hi - lo + 1 AS size
      FROM proba p JOIN sets s ON p.id = s.id AND alpha = 0.1 WHERE p.split = 'test'),
    g AS (SELECT least(9, floor(confidence * 10)) AS bin, sum(ok::INT) AS h, sum(confidence) AS c
      FROM a GROUP BY 1)
    SELECT count(*) AS n, round(avg(ok::INT), 6) AS accuracy,
      round(avg(confidence), 6) AS mean_confidence,
      round((SELECT sum(abs(h - c)) FROM g) / count(*), 6) AS ece,
      round(avg(covered::INT), 6) AS coverage, round(avg(size), 6) AS mean_set_size,
      round(avg((size >= 4)::INT), 6) AS abstain_share FROM a""", "scores"))
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = uncertain.with_prediction_set(
        proba(spark, sf_dir, "test"), thresholds(spark, sf_dir), SCORE_CLASSES
    ).select(
        "confidence", "set_size",
        (F.col("answer") == F.col("true_label")).alias("correct"),
        F.array_contains("conformal_set", F.col("true_label")).alias("covered"),
        F.col("abstain").alias("abstained"),
    )
    return rounded(
        uncertain.calibration_summary(frame),
        "accuracy", "mean_confidence", "ece", "coverage", "mean_set_size", "abstain_share",
    )


@query("ordinal_cross_entropy", "D32", sql=with_views(
    """l AS (SELECT split, true_rank, list_transform(scores, lambda x: x - list_max(scores)
        - ln(list_sum(list_transform(scores, lambda y: exp(y - list_max(scores)))))) AS lp,
        [exp(-abs(i - true_rank)::DOUBLE) FOR i IN range(10)] AS w FROM scores)
    SELECT split, count(*) AS n, round(avg(-list_sum([lp[i] * w[i] FOR i IN range(1, 11)])
      / list_sum(w)), 6) AS loss FROM l GROUP BY split""", "scores"))
def _ordinal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uncertain.mean_ordinal_loss(scores(spark, sf_dir), by=["split"]), "loss")


@query("even_spread_distribution", "P16", "D15", sql=with_views(
    f"""c AS (SELECT certainty, round((sum((rule_time = label_time)::INT) + 1)
        / (count(*) + 2), 4) AS conf FROM answers_wide GROUP BY certainty)
    SELECT case_id, round(conf, 4) AS confidence, {', '.join(
        f"CASE WHEN rule_space = '{s}' THEN conf ELSE round((1 - conf) / 4, 4) END AS p{i}"
        for i, s in enumerate(SEGMENTS))}
    FROM answers_wide JOIN c USING (certainty)""", "answers_wide"))
def _even_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = answers_wide(spark, sf_dir)
    # one row per certainty level: three at most
    levels = cases.groupBy("certainty").agg(
        laplace(
            F.count_if(judge.hit(F.col("rule_time"), F.col("label_time"))), F.count(F.lit(1))
        ).alias("confidence")
    )
    spread = cases.join(F.broadcast(levels), "certainty").select(
        "case_id", F.round("confidence", 4).alias("confidence"),
        sc.even_spread(F.col("rule_space"), F.col("confidence"), SEGMENTS).alias("d"),
    )
    return spread.select(
        "case_id", "confidence", *[F.col("d")[s].alias(f"p{i}") for i, s in enumerate(SEGMENTS)]
    )
