"""Registered queries: ranks, metrics, tallies, promotion, certainty and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.hashing import stable_bucket
from rankwell.functions.ordinal import (
    EXTENDED_TIME_CLASSES,
    LEGACY_OF_EXTENDED,
    class_at,
    ordinal_distance,
    rank_of,
    rounded_class,
)
from rankwell.functions.stats import laplace
from rankwell.operators import judge, predictors
from rankwell.plans.adapters import (
    PRIORITIES,
    SEGMENTS,
    answers,
    answers_wide,
    bucket_sql,
    corpus,
    table,
    with_views,
)
from rankwell.plans.catalog import query
from rankwell.plans.curation_queries import audit_entries

P = list(PRIORITIES)
S = list(SEGMENTS)


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


# -------------------------------------------------------------------------- ordinals
@query("ordinal_rank_and_distance", "P2", sql=with_views(
    f"""SELECT case_id, (list_position({P}, label_time) - 1)::INT AS label_rank,
      (list_position({P}, model_time) - 1)::INT AS answer_rank,
      abs(list_position({P}, label_time) - list_position({P}, model_time))::INT AS distance
    FROM answers_wide""", "answers_wide"))
def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers_wide(spark, sf_dir).select(
        "case_id",
        rank_of(F.col("label_time"), PRIORITIES).alias("label_rank"),
        rank_of(F.col("model_time"), PRIORITIES).alias("answer_rank"),
        ordinal_distance(F.col("label_time"), F.col("model_time"), PRIORITIES).alias("distance"),
    )


_EXT = list(EXTENDED_TIME_CLASSES)
_LEGACY = [LEGACY_OF_EXTENDED[c] for c in EXTENDED_TIME_CLASSES]


@query("extended_class_rounding", "P3", sql=f"""
  SELECT o_orderkey, {_EXT}[least(floor(o_totalprice / 50000)::INT, 9) + 1] AS extended_class,
    {_LEGACY}[least(floor(o_totalprice / 50000)::INT, 9) + 1] AS class FROM orders""")
def _rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.least(F.floor(F.col("o_totalprice") / 50000), F.lit(9))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", class_at(band, EXTENDED_TIME_CLASSES).alias("extended_class")
    ).withColumn("class", rounded_class(F.col("extended_class")))


# --------------------------------------------------------------------------- metrics
def metrics_sql(source: str, classes: list[str], by: str = "") -> str:
    """Metrics from their definition: one scan per class, no shared confusion table."""
    group = f"{by}, " if by else ""
    f1 = " + ".join(
        f"coalesce(2.0 * count_if(label = '{c}' AND answer = '{c}')"
        f" / nullif(count_if(label = '{c}') + count_if(answer = '{c}'), 0), 0)"
        for c in classes
    )
    return f"""SELECT {group} count(*) AS n,
      round(avg(coalesce(label = answer, false)::INT), 6) AS accuracy, round(({f1}) / {len(classes)}, 6) AS macro_f1,
      round(avg(coalesce(abs(list_position({classes}, label) - list_position({classes}, answer)),
        {len(classes) - 1})), 6)
        AS mean_ordinal_distance
    FROM {source} {f'GROUP BY {by}' if by else ''}"""


def answered(spark: SparkSession, sf_dir: str, dimension: str = "time") -> DataFrame:
    return answers(spark, sf_dir).filter(
        (F.col("dimension") == dimension) & (F.col("predictor") == "model")
        & F.col("label").isNotNull()
    )


_ANSWERED = """answered AS (SELECT * FROM answers WHERE dimension = '{d}'
  AND predictor = 'model' AND label IS NOT NULL)"""


@query("evaluation_metrics", "D6", sql=with_views(
    _ANSWERED.format(d="time") + metrics_sql("answered", P), "answers"))
def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        judge.metrics(answered(spark, sf_dir), PRIORITIES),
        "accuracy", "macro_f1", "mean_ordinal_distance",
    )


@query("evaluation_class_f1", "D6", sql=with_views(
    _ANSWERED.format(d="space") + f""", c AS (SELECT unnest({S + ['NEVER SEEN']}) AS class)
    SELECT class, count_if(label = class)::BIGINT AS support,
      count_if(answer = class)::BIGINT AS predicted,
      count_if(label = class AND answer = class)::BIGINT AS tp,
      round(coalesce(2.0 * count_if(label = class AND answer = class)
        / nullif(count_if(label = class) + count_if(answer = class), 0), 0), 6) AS f1
    FROM c CROSS JOIN answered GROUP BY class""", "answers"))
def _class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    confusion = judge.confusion_counts(answered(spark, sf_dir, "space"))
    return rounded(judge.class_scores(confusion, [*SEGMENTS, "NEVER SEEN"]), "f1")


@query("per_language_metrics", "D7", sql=with_views(
    _ANSWERED.format(d="time") + metrics_sql("answered", P, "language"), "answers"))
def _language_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        judge.metrics(answered(spark, sf_dir), PRIORITIES, ["language"]),
        "accuracy", "macro_f1", "mean_ordinal_distance",
    )


def _matrix_sql(cell: str) -> str:
    cells = ", ".join(cell.format(c=c) for c in P)
    return with_views(
        f"""{_ANSWERED.format(d='time')} SELECT label, {cells} FROM answered GROUP BY label""",
        "answers",
    )


@query("confusion_matrix", "D10", sql=_matrix_sql(
    "count_if(answer = '{c}')::BIGINT AS \"{c}\""))
def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.confusion_matrix(answered(spark, sf_dir), PRIORITIES)


@query("confusion_recall", "D10", sql=_matrix_sql(
    "round(count_if(answer = '{c}') / count(*), 6) AS \"{c}\""))
def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = judge.confusion_matrix(answered(spark, sf_dir), PRIORITIES, recall=True)
    return matrix.select("label", *[F.round(f"`{c}`", 6).alias(c) for c in PRIORITIES])


# -------------------------------------------------------------- tallies and promotion
_WILSON = """round(CASE WHEN total = 0 THEN {edge} ELSE {clip}({edge},
  (p + 3.8416 / (2 * total) {sign} 1.96 * sqrt(p * (1 - p) / total
    + 3.8416 / (4 * total * total))
  / 1.0) / (1 + 3.8416 / total)) END, {digits})"""


def wilson_sql(side: str, correct: str, total: str, digits: int = 6) -> str:
    edge, clip, sign = ("0.0", "greatest", "-") if side == "low" else ("1.0", "least", "+")
    n = f"{total}::DOUBLE"
    p = f"({correct} / {n})"
    body = (
        f"({p} + 3.8416 / (2 * {n}) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n}"
        f" + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n})"
    )
    return f"round(CASE WHEN {total} = 0 THEN {edge} ELSE {clip}({edge}, {body}) END, {digits})"


_TALLY = """t AS (SELECT language, predictor, dimension,
  sum(coalesce((answer = label)::INT, 0))::BIGINT AS correct, count(*) AS total
  FROM answers WHERE label IS NOT NULL GROUP BY ALL)"""


@query("tally_by_slice", "D9", sql=with_views(
    f"{_TALLY} SELECT * FROM t", "answers"))
def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.tally(answers(spark, sf_dir), ["language", "predictor", "dimension"])


@query("wilson_intervals", "D8", sql=with_views(
    f"""{_TALLY}, u AS (SELECT * FROM t UNION ALL SELECT DISTINCT language, 'nobody', dimension,
      0, 0 FROM t) SELECT language, predictor, dimension, correct, total,
      {wilson_sql('low', 'correct', 'total')} AS low,
      {wilson_sql('high', 'correct', 'total')} AS high FROM u""", "answers"))
def _wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = judge.tally(answers(spark, sf_dir), ["language", "predictor", "dimension"])
    zero = F.lit(0).cast("bigint")
    nobody = tallies.select("language", "dimension").distinct().select(
        "language", F.lit("nobody").alias("predictor"), "dimension",
        zero.alias("correct"), zero.alias("total"),
    )
    return judge.with_interval(tallies.unionByName(nobody), digits=6)


def _sides(prefix: str, predictor: str) -> str:
    return f"""sum(CASE WHEN predictor = '{predictor}' THEN coalesce((answer = label)::INT, 0)
      ELSE 0 END)::BIGINT AS {prefix}_correct,
      count_if(predictor = '{predictor}')::BIGINT AS {prefix}_total"""


@query("slice_promotion", "J5", "D8", "D9", sql=with_views(
    f"""t AS (SELECT language || '/' || certainty || '/' || (case_id % 40) AS slice, dimension,
      {_sides('engine', 'rule')}, {_sides('model', 'model')}
      FROM answers WHERE label IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT *, {wilson_sql('low', 'engine_correct', 'engine_total', 9)} AS el,
      {wilson_sql('high', 'engine_correct', 'engine_total', 9)} AS eh,
      {wilson_sql('low', 'model_correct', 'model_total', 9)} AS ml,
      {wilson_sql('high', 'model_correct', 'model_total', 9)} AS mh FROM t)
    SELECT slice, dimension, engine_total AS rows, engine_correct, engine_total,
      round(el, 3) AS engine_low, round(eh, 3) AS engine_high, model_correct, model_total,
      round(ml, 3) AS model_low, round(mh, 3) AS model_high,
      CASE WHEN engine_total >= 20 AND ml > eh THEN 'model' ELSE 'engine' END AS answers,
      CASE WHEN engine_total >= 20 AND ml > eh THEN 'model''s interval is above the engine''s'
        WHEN engine_total >= 20 THEN 'model not better beyond the noise of the sample'
        ELSE 'fewer than 20 rows: the engine stays the default' END AS reason FROM w""",
    "answers"))
def _promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).withColumn("fold", F.col("case_id") % 40)
    return judge.promotion(rows, "rule", "model", ("language", "certainty", "fold"))


@query("prediction_truth_join", "J2", "D6", sql=with_views(
    f"""scored AS (SELECT label_time AS label, rule_time AS answer FROM answers_wide
      WHERE b % 7 <> 0) {metrics_sql('scored', P)}""", "answers_wide"))
def _score_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = answers_wide(spark, sf_dir)
    truth = cases.select("case_id", F.col("label_time").alias("label"))
    given = cases.filter(F.col("b") % 7 != 0).select("case_id", F.col("rule_time").alias("answer"))
    return rounded(
        judge.score_predictions(truth, given, "case_id", PRIORITIES),
        "accuracy", "macro_f1", "mean_ordinal_distance",
    )


@query("missing_predictions", "J2", sql=with_views(
    "SELECT case_id FROM answers_wide WHERE b % 7 = 0", "answers_wide"))
def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = answers_wide(spark, sf_dir)
    return judge.missing_predictions(
        cases.select("case_id"), cases.filter(F.col("b") % 7 != 0), "case_id"
    )


@query("hash_verified_join", "J3", "P5", sql=with_views(
    f"""entries AS (SELECT source || ':' || solution_id AS id,
      CASE WHEN {bucket_sql('solution_id')} % 5 = 0 THEN 'disagreement' ELSE 'random' END AS kind,
      CASE WHEN {bucket_sql('solution_id')} % 7 = 0 THEN 'low' ELSE 'high' END AS confidence,
      CASE WHEN {bucket_sql('solution_id')} % 3 = 0 THEN sha256('changed') ELSE sha256(code) END
        AS sha, language, code FROM corpus WHERE time_class IS NOT NULL)
    SELECT id, language, sha AS sha256 FROM entries
    WHERE kind = 'random' AND confidence <> 'low' AND sha = sha256(code)""", "corpus"))
def _hash_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = corpus(spark, sf_dir)
    bucket = stable_bucket(F.col("solution_id"))
    audit = records.filter(F.col("time_class").isNotNull()).select(
        F.concat_ws(":", "source", "solution_id").alias("id"),
        F.when(bucket % 5 == 0, "disagreement").otherwise("random").alias("kind"),
        F.when(bucket % 7 == 0, "low").otherwise("high").alias("confidence"),
        F.when(bucket % 3 == 0, F.sha2(F.lit("changed"), 256))
        .otherwise(F.sha2("code", 256)).alias("sha256"),
    )
    return judge.hash_verified(records, audit).select("id", "language", "sha256")


def _pairs(name: str, alias: str) -> str:
    return f"""{alias} AS (SELECT dimension AS metric, case_id || ':' || language AS pair
      FROM answers WHERE predictor = '{name}' AND answer = label)"""


@query("ratchet_regressions_and_improvements", "J4", sql=with_views(
    f"""{_pairs('model', 'cur')}, {_pairs('rule', 'base')}
    (SELECT 'regression' AS change, * FROM (SELECT * FROM base EXCEPT SELECT * FROM cur))
    UNION ALL
    (SELECT 'improvement', * FROM (SELECT * FROM cur EXCEPT SELECT * FROM base))""", "answers")
    .replace("label)\n", "label)\n").replace("answer = label)\n    (SELECT 'regr", "answer = label)\n    (SELECT 'regr"))
def _ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    return judge.ratchet(judge.passing_pairs(rows, "model"), judge.passing_pairs(rows, "rule"))


# ---------------------------------------------------------------------------- certainty
def first_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers_wide(spark, sf_dir).select(
        "case_id", "language",
        F.when(F.col("b") % 37 == 0, "error").otherwise(F.col("certainty")).alias("certainty"),
        "label_time", "label_space",
        F.col("model_time").alias("answer_time"), F.col("model_space").alias("answer_space"),
    )


_CONTACT = """contact AS (SELECT * REPLACE (CASE WHEN b % 37 = 0 THEN 'error' ELSE certainty END
  AS certainty) FROM answers_wide)"""
_CONTACT_LONG = _CONTACT + """, long AS (
  SELECT certainty, language, 'time' AS dimension, label_time AS label, model_time AS answer
    FROM contact UNION ALL
  SELECT certainty, language, 'space', label_space, model_space FROM contact)"""


@query("certainty_level_accuracy", "D13", "D15", sql=with_views(
    f"""{_CONTACT_LONG}, c AS (SELECT certainty, dimension,
        sum(coalesce((label = answer)::INT, 0))::BIGINT AS correct, count(*) AS total
      FROM long WHERE certainty IN ('certain', 'assumed') GROUP BY 1, 2)
    SELECT *, round((correct + 1) / (total + 2), 6) AS confidence FROM c""", "answers_wide"))
def _certainty_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = judge.certainty_levels(first_contact(spark, sf_dir))
    return rounded(judge.with_confidence(levels), "confidence")


@query("calibration_payload", "D14", sql=with_views(
    f"""{_CONTACT} SELECT 'certainty_counts' AS part, certainty AS key, NULL::BIGINT AS correct,
      count(*) AS total FROM contact GROUP BY certainty
    UNION ALL SELECT 'joint_accuracy_by_language', language,
      sum(coalesce((label_time = model_time AND label_space = model_space)::INT, 0))::BIGINT,
      count(*)
    FROM contact WHERE certainty IN ('certain', 'assumed') GROUP BY language""", "answers_wide"))
def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.calibration_payload(first_contact(spark, sf_dir))


@query("laplace_confidence", "D15", sql=with_views(
    f"{_TALLY} SELECT *, round((correct + 1) / (total + 2), 6) AS confidence FROM t", "answers"))
def _laplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = judge.tally(answers(spark, sf_dir), ["language", "predictor", "dimension"])
    return tallies.withColumn("confidence", r6(laplace(F.col("correct"), F.col("total"))))


@query("first_contact_agreement", "D16", sql=with_views(
    f"""{_CONTACT_LONG}, g AS (SELECT d.dimension, c.* FROM
      (VALUES ('certain', 0), ('assumed', 1), ('unknown', 2)) c(certainty, position),
      (VALUES ('time'), ('space')) d(dimension))
    SELECT g.dimension, position, g.certainty,
      count_if(label = answer)::BIGINT AS correct, count(label) AS total
    FROM g LEFT JOIN long l ON g.dimension = l.dimension AND g.certainty = l.certainty
      AND label IS NOT NULL GROUP BY ALL""", "answers_wide"))
def _first_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.first_contact_agreement(first_contact(spark, sf_dir))


_AUDIT = """e AS (SELECT language AS source, kind, 'time' AS dimension, ct AS corpus, rule_time AS engine,
    model_time AS agent FROM a UNION ALL
  SELECT language, kind, 'space', label_space, rule_space, model_space FROM a),
  u AS (SELECT *, corpus IS NOT DISTINCT FROM agent AS co, engine IS NOT DISTINCT FROM agent AS eo
    FROM e WHERE corpus IS NOT NULL)"""


@query("label_audit", "D17", "P5", sql=with_views(
    f"""a AS (SELECT *, CASE WHEN b % 3 = 0 THEN 'disagreement' ELSE 'random' END AS kind,
        CASE WHEN b % 13 <> 0 THEN label_time END AS ct FROM answers_wide WHERE b % 4 <> 0),
    {_AUDIT}, w AS (
      SELECT 'random' AS "table", dimension, 'all' AS source, count(*) AS rows,
        count_if(co) AS corpus_right, count_if(eo) AS engine_right, count_if(co AND eo) AS
        both_right, count_if(NOT co AND NOT eo) AS neither_right FROM u WHERE kind = 'random'
      GROUP BY dimension)
    SELECT "table", dimension, source, measure, n::BIGINT AS n FROM w UNPIVOT (n FOR measure IN
      (rows, corpus_right, engine_right, both_right, neither_right))
    UNION ALL SELECT 'by_source', dimension, source, 'rows', count(*) FROM u
      WHERE kind = 'random' GROUP BY dimension, source
    UNION ALL SELECT 'by_source', dimension, source, 'corpus_right', count_if(co)::BIGINT FROM u
      WHERE kind = 'random' GROUP BY dimension, source
    UNION ALL SELECT 'disagreement', dimension, 'all', 'rows', count(*) FROM u
      WHERE kind = 'disagreement' GROUP BY dimension
    UNION ALL SELECT 'disagreement', dimension, 'all', 'engine_right', count_if(eo)::BIGINT FROM u
      WHERE kind = 'disagreement' GROUP BY dimension
    UNION ALL SELECT 'disagreement', dimension, 'all', 'corpus_right',
      count_if(co AND NOT eo)::BIGINT FROM u WHERE kind = 'disagreement' GROUP BY dimension
    UNION ALL SELECT 'disagreement', dimension, 'all', 'neither',
      count_if(NOT co AND NOT eo)::BIGINT FROM u WHERE kind = 'disagreement' GROUP BY dimension""",
    "answers_wide"))
def _label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.label_audit(audit_entries(spark, sf_dir))


# ---------------------------------------------------------------------------- scorecard
def golden_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case results over the answers: four languages per case, expressions on some rows."""
    cases = answers_wide(spark, sf_dir)
    right = F.coalesce(F.col("model_time") == F.col("label_time"), F.lit(False))
    base = cases.select(
        F.floor(F.col("case_id") / 4).alias("case_id"),
        F.concat(F.lit("l"), F.col("case_id") % 4).alias("language"),
        F.concat(F.lit("g"), F.col("b") % 3).alias("group"),
        (F.col("b") % 29 == 0).alias("known_limitation"),
        (F.floor(F.col("case_id") / 4) % 6 == 0).alias("has_overrides"),
        F.when(F.col("b") % 41 == 0, "ValueError: no answer").alias("error"),
        F.col("label_time").alias("expected_time"),
        F.coalesce("label_space", F.lit("BUILDING")).alias("expected_space"),
        F.when(F.col("b") % 41 != 0, F.col("model_time")).alias("answer_time"),
        F.when(F.col("b") % 41 != 0, F.col("model_space")).alias("answer_space"),
        F.lit("O(n * m log n)").alias("expected_time_expr"),
        F.when(right, "O(m*log(n) * n)").when(F.col("b") % 2 == 0, "O(m * n log m)").alias(
            "answer_time_expr"
        ),
        F.lit("O(n + m)").alias("expected_space_expr"),
        F.lit(None).cast("string").alias("answer_space_expr"),
    )
    return judge.case_results(base, PRIORITIES, SEGMENTS)


_GOLDEN = f"""golden AS (
  SELECT case_id // 4 AS case_id, 'l' || (case_id % 4) AS language, 'g' || (b % 3) AS "group",
    b % 29 = 0 AS known_limitation, (case_id // 4) % 6 = 0 AS has_overrides,
    CASE WHEN b % 41 = 0 THEN 'ValueError: no answer' END AS error, label_time AS expected_time,
    coalesce(label_space, 'BUILDING') AS expected_space,
    CASE WHEN b % 41 <> 0 THEN model_time END AS answer_time,
    CASE WHEN b % 41 <> 0 THEN model_space END AS answer_space,
    CASE WHEN coalesce(model_time = label_time, false) THEN 1 WHEN b % 2 = 0 THEN 0 END AS teo
  FROM answers_wide),
results AS (SELECT *, coalesce(answer_time = expected_time, false) AS time_ok,
    coalesce(answer_space = expected_space, false) AS space_ok,
    coalesce(abs(list_position({P}, answer_time) - list_position({P}, expected_time)), 5) AS te,
    coalesce(abs(list_position({S}, answer_space) - list_position({S}, expected_space)), 5) AS se
  FROM golden)"""
_SLICE = """count(*) AS n, round(avg(time_ok::INT), 6) AS time_accuracy,
  round(avg(space_ok::INT), 6) AS space_accuracy, round(avg(te), 6) AS mean_time_rank_error,
  round(avg(se), 6) AS mean_space_rank_error, round(avg(teo), 6) AS time_expr_accuracy,
  NULL::DOUBLE AS space_expr_accuracy, count(error) AS errors FROM results"""


@query("scorecard_slices", "D19", "P19", sql=with_views(
    f"""{_GOLDEN}
    SELECT 'overall' AS slice, 'all' AS key, {_SLICE} WHERE NOT known_limitation
    UNION ALL SELECT 'known_limitations', 'all', {_SLICE} WHERE known_limitation
    UNION ALL SELECT 'language', language, {_SLICE} WHERE NOT known_limitation GROUP BY language
    UNION ALL SELECT 'time_class', expected_time, {_SLICE} WHERE NOT known_limitation GROUP BY 2
    UNION ALL SELECT 'space_class', expected_space, {_SLICE} WHERE NOT known_limitation GROUP BY 2
    UNION ALL SELECT 'group', "group", {_SLICE} WHERE NOT known_limitation GROUP BY 2""",
    "answers_wide").replace("results)\n    SELECT", "results)\n    SELECT").replace(
        "FROM golden),\n\n    SELECT", "FROM golden)\n    SELECT"))
def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        judge.scorecard(golden_results(spark, sf_dir)),
        "time_accuracy", "space_accuracy", "mean_time_rank_error", "mean_space_rank_error",
        "time_expr_accuracy", "space_expr_accuracy",
    )


@query("scorecard_failing_pairs", "D19", sql=with_views(
    f"""{_GOLDEN} SELECT case_id, language FROM results
    WHERE NOT known_limitation AND NOT (time_ok AND space_ok)""", "answers_wide"))
def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.failing_pairs(golden_results(spark, sf_dir))


@query("cross_language_consistency", "D20", sql=with_views(
    f"""{_GOLDEN}, c AS (SELECT case_id, count(*) AS k, bool_and(error IS NULL) AS clean,
      count(DISTINCT coalesce(answer_time, '?') || '|' || coalesce(answer_space, '?')) = 1 AS same,
      bool_and(time_ok AND space_ok) AS ok FROM results
      WHERE NOT known_limitation AND NOT has_overrides GROUP BY case_id)
    SELECT count(*) AS cases, round(avg((clean AND same)::INT), 6) AS consistent,
      round(avg(ok::INT), 6) AS correct FROM c WHERE k >= 2""", "answers_wide"))
def _consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        judge.cross_language_consistency(golden_results(spark, sf_dir)), "consistent", "correct"
    )


@query("experiment_readout", "D29", sql=with_views(
    f"""m AS ({metrics_sql('''(SELECT dimension || '/' || predictor || '/' || certainty AS name,
        label, answer FROM answers WHERE dimension = 'time' AND label IS NOT NULL)''', P, 'name')}),
    base AS (SELECT macro_f1 AS f FROM m WHERE name = 'time/rule/certain')
    SELECT (SELECT arg_max(name, (macro_f1, name)) FROM m) AS winner,
      (SELECT max(macro_f1) FROM m) AS winner_macro_f1,
      round((SELECT max(macro_f1) FROM m) - f, 6) AS lead,
      (SELECT arg_min(name, (macro_f1, name)) FROM m WHERE name <> 'time/rule/certain') AS costliest,
      round(f - (SELECT min(macro_f1) FROM m WHERE name <> 'time/rule/certain'), 6) AS "drop"
    FROM base""", "answers"))
def _readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).filter(
        (F.col("dimension") == "time") & F.col("label").isNotNull()
    )
    named = rows.withColumn("name", F.concat_ws("/", "dimension", "predictor", "certainty"))
    scored = judge.metrics(named, PRIORITIES, ["name"])
    results = scored.select("name", r6("macro_f1").alias("macro_f1"))
    return rounded(judge.experiment_readout(results, "time/rule/certain"), "lead", "drop")


# --------------------------------------------------------------------------- predictors
def _rule_model(batch):
    """A user's batch model: price band to class; refuses one bucket."""
    if (batch["b"] == 999).any():
        raise ValueError("bucket out of range")
    names = dict(enumerate(PRIORITIES))
    out = batch.copy()
    out["time"] = batch["band"].map(names)
    out["space"] = None
    return out


@query("predictor_registry", "E1", sql=with_views(
    f"""b AS (SELECT *, ((list_position({P}, rule_time) - 1))::INT AS band FROM answers_wide)
    SELECT case_id, 'rule' AS predictor, rule_time AS time, rule_space AS space,
      NULL::VARCHAR AS certainty, 'rule' AS engine, NULL::VARCHAR AS error FROM b
    UNION ALL SELECT case_id, 'model', model_time, model_space, certainty, 'model',
      CASE WHEN model_time IS NULL THEN 'no answer' END FROM b
    UNION ALL SELECT case_id, 'batch', CASE WHEN b < 999 THEN rule_time END, NULL, NULL, 'batch',
      CASE WHEN b = 999 THEN 'ValueError: bucket out of range' END FROM b""", "answers_wide"))
def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictors.register_predictor(
        "rule", lambda f: predictors.prediction(F.col("rule_time"), F.col("rule_space"), "rule")
    )
    predictors.register_predictor(
        "model",
        lambda f: predictors.prediction(
            F.col("model_time"), F.col("model_space"), "model", F.col("certainty"),
            F.when(F.col("model_time").isNull(), "no answer"),
        ),
    )
    predictors.register_predictor(
        "batch", predictors.model_predictor("batch", _rule_model, ["band", "b"])
    )
    cases = answers_wide(spark, sf_dir).withColumn(
        "band", rank_of(F.col("rule_time"), PRIORITIES)
    )
    return predictors.predict_all(cases, ["rule", "model", "batch"], ["case_id"])


@query("hybrid_answer_selection", "P15", sql=with_views(
    """h AS (SELECT *, CASE WHEN b % 43 = 0 THEN 'TypeError: engine failed' END AS e
      FROM answers_wide), s AS (SELECT *, e IS NULL AND certainty <> 'unknown' AS served FROM h)
    SELECT case_id, CASE WHEN served THEN 'symbolic' ELSE 'ml_fallback' END AS engine,
      CASE WHEN served THEN rule_time ELSE model_time END AS answer_time,
      CASE WHEN served THEN rule_space ELSE model_space END AS answer_space,
      array_to_string(list_filter([CASE WHEN b % 10 = 0 THEN 'a large share of parsed nodes were unmapped (UNKNOWN) -- predictions may be unreliable' END,
        CASE WHEN NOT served THEN 'the symbolic engine could not bound this code ('
          || coalesce(e, 'no cost bound could be derived') || '); the answer below comes from '
          || 'the ML fallback model, which is less reliable' END], lambda x: x IS NOT NULL), ' | ')
        AS warnings FROM s""", "answers_wide"))
def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = answers_wide(spark, sf_dir).select(
        "case_id", "certainty",
        F.col("rule_time").alias("primary_time"), F.col("rule_space").alias("primary_space"),
        F.col("model_time").alias("fallback_time"), F.col("model_space").alias("fallback_space"),
        F.when(F.col("b") % 43 == 0, "TypeError: engine failed").alias("primary_error"),
        (F.col("b") % 10 == 0).alias("unknown_share_high"),
    )
    return predictors.hybrid(cases).withColumn("warnings", F.array_join("warnings", " | "))
