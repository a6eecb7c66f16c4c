"""Registered queries: baseline models, ablations, importances and attributions.

Model fits have no oracle; their inputs and the pure-arithmetic parts do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.operators import fit, judge, serve
from rankwell.operators.curate import with_split
from rankwell.plans.adapters import corpus, table, with_views
from rankwell.plans.catalog import query
from rankwell.plans.curation_queries import SPLIT_SQL
from rankwell.plans.judging_queries import rounded

CLASSES = ("0", "1")
FAMILIES = {
    "size": ("n_chars", "n_lines", "n_words"),
    "letters": ("n_capitals", "n_digits"),
    "marks": ("n_marks", "n_stops"),
}
TEXT_FEATURES = tuple(f for members in FAMILIES.values() for f in members)
#: Most iterations of the text models, as in the library; they end by their tolerance.
ITERATIONS = 2_000


def text_features(frame: DataFrame) -> DataFrame:
    """Plain counts over the whole text."""
    size = F.length("code")
    count = lambda pattern: (size - F.length(F.regexp_replace("code", pattern, ""))).cast("double")
    return frame.withColumns(
        {
            "n_chars": size.cast("double"),
            "n_lines": F.size(F.split("code", "\n")).cast("double"),
            "n_words": F.size(F.split("code", " ")).cast("double"),
            "n_capitals": count("[A-Z]"),
            "n_digits": count("[0-9]"),
            "n_marks": count("[#*%<>{}|&;]"),
            "n_stops": count("[.]"),
        }
    )


_FEATURES = """feats AS (SELECT *, length(code)::DOUBLE AS n_chars,
    len(string_split(code, chr(10)))::DOUBLE AS n_lines,
    len(string_split(code, ' '))::DOUBLE AS n_words,
    (length(code) - length(regexp_replace(code, '[A-Z]', '', 'g')))::DOUBLE AS n_capitals,
    (length(code) - length(regexp_replace(code, '[0-9]', '', 'g')))::DOUBLE AS n_digits,
    (length(code) - length(regexp_replace(code, '[#*%<>{}|&;]', '', 'g')))::DOUBLE AS n_marks,
    (length(code) - length(replace(code, '.', '')))::DOUBLE AS n_stops FROM corpus)"""


def labelled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Labelled documents with features, kept by their split of problems."""
    rows = with_split(
        text_features(corpus(spark, sf_dir).filter(F.col("time_class").isNotNull()))
    )
    shape = F.transform(
        F.split("code", " "), lambda w: F.concat(F.lit("w"), F.least(F.length(w), F.lit(12)))
    )
    rows = rows.withColumn("shape", F.array_join(shape, " "))
    return {s: rows.filter(F.col("split") == s) for s in ("train", "val", "test")}


METRICS = ("accuracy", "macro_f1", "mean_ordinal_distance")


@query("feature_matrix", "M11", sql=with_views(
    f"{_FEATURES} SELECT solution_id, {', '.join(TEXT_FEATURES)} FROM feats", "corpus"))
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    vectors = fit.assembled(text_features(corpus(spark, sf_dir)), TEXT_FEATURES)
    values = vector_to_array("features")
    return vectors.select(
        "solution_id", *[F.get(values, F.lit(i)).alias(f) for i, f in enumerate(TEXT_FEATURES)]
    )


@query("text_model", "M1")
def _text_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = labelled(spark, sf_dir)
    model = fit.fit_text(
        splits["train"], "code", "time_class", CLASSES, max_iter=ITERATIONS
    )
    return rounded(judge.metrics(model.score(splits["test"]), CLASSES, label="time_class"), *METRICS)


_TRAIN = f"""{_FEATURES}, train AS (SELECT * FROM feats WHERE {SPLIT_SQL} = 'train' AND time_class IS NOT NULL)"""
_WEIGHTS_SQL = """weights AS (SELECT time_class, count(*) AS n,
    (SELECT count(*) / count(DISTINCT time_class) FROM train) / count(*) AS weight FROM train GROUP BY 1)"""


@query("class_weights", "M1", "M2", sql=with_views(
    f"""{_TRAIN}, {_WEIGHTS_SQL} SELECT time_class, n, round(weight, 9) AS weight FROM weights""", "corpus"))
def _class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.class_weights(labelled(spark, sf_dir)["train"], "time_class").withColumn(
        "weight", F.round("weight", 9)
    )


@query("ngram_vocabulary", "M1", "M4", sql=with_views(
    f"""{_TRAIN}, w AS (SELECT solution_id,
      regexp_extract_all(lower(code), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_][\\p{{L}}\\p{{M}}\\p{{Nd}}_]+') AS w FROM train),
    g AS (SELECT DISTINCT solution_id, unnest(list_concat(w,
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM w)
    SELECT gram, count(*) AS df, round(ln(((SELECT count(*) FROM train) + 1) / (count(*) + 1)) + 1, 9) AS idf
    FROM g GROUP BY gram ORDER BY df DESC, gram LIMIT {fit.VOCABULARY}""", "corpus"))
def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = labelled(spark, sf_dir)["train"]
    n = train.agg(F.count(F.lit(1))).scalar()
    return fit.vocabulary(train, "code").select(
        "gram", "df", F.round(fit.smooth_idf(F.col("df"), n), 9).alias("idf")
    )


@query("first_splits", "M2", "M12", sql=with_views(
    f"""{_TRAIN}, {_WEIGHTS_SQL}, v AS (UNPIVOT (SELECT time_class, weight, {', '.join(TEXT_FEATURES)}
      FROM train JOIN weights USING (time_class)) ON {', '.join(TEXT_FEATURES)} INTO NAME feature VALUE value),
    e AS (SELECT feature, unnest(list_distinct(quantile_disc(value, {[k / 255 for k in range(1, 256)]}))) AS upto
      FROM v GROUP BY feature),
    h AS (SELECT v.feature, (SELECT min(upto) FROM e WHERE e.feature = v.feature AND upto >= value) AS upto,
      weight, time_class FROM v),
    b AS (SELECT feature, upto, sum(weight) AS t, sum(weight * time_class::INT) AS p FROM h GROUP BY 1, 2),
    c AS (SELECT feature, upto, sum(t) OVER w AS l, sum(p) OVER w AS lp, sum(t) OVER a AS n, sum(p) OVER a AS p,
      max(upto) OVER a AS last FROM b
      WINDOW w AS (PARTITION BY feature ORDER BY upto), a AS (PARTITION BY feature)),
    g AS (SELECT feature, upto, lp * lp / l + (p - lp) * (p - lp) / (n - l) - p * p / n AS gain
      FROM c WHERE upto < last)
    SELECT feature, upto, round(gain, 6) AS gain FROM g
    QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, upto) = 1""", "corpus"))
def _first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fit.balanced(labelled(spark, sf_dir)["train"], CLASSES, "time_class")
    histogram = fit.split_histogram(train, "label_index", "weight", TEXT_FEATURES)
    return fit.best_splits(histogram).withColumn("gain", F.round("gain", 6))


@query("tree_model", "M2")
def _tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = labelled(spark, sf_dir)
    model = fit.fit_trees(splits["train"], "time_class", CLASSES, TEXT_FEATURES)
    return rounded(judge.metrics(model.score(splits["test"]), CLASSES, label="time_class"), *METRICS)


@query("family_ablation", "M3")
def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = labelled(spark, sf_dir)
    results = fit.family_ablation(
        splits["train"], splits["test"], "time_class", CLASSES, FAMILIES
    )
    return rounded(results, *METRICS)


@query("symbols_vs_tokens_ablation", "M4")
def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = labelled(spark, sf_dir)
    inputs = {"ir_symbol_tfidf": "shape", "raw_token_tfidf": "code"}
    results = fit.text_ablation(splits["train"], splits["test"], "time_class", CLASSES, inputs, ITERATIONS)
    return rounded(results, *METRICS)


@query("language_transfer", "M5", "P6")
def _transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = labelled(spark, sf_dir)
    results = fit.transfer(
        splits["train"], splits["test"], "code", "time_class", CLASSES, ["en", "fr"], ITERATIONS
    )
    return rounded(results, *METRICS)


@query("model_ladder", "M6", "M7", "J8", "F4")
def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("n_words") < 30, "0").otherwise("1")
    results = fit.ladder(
        labelled(spark, sf_dir), "time_class", CLASSES, rule, "code", TEXT_FEATURES,
        max_iter=ITERATIONS,
    )
    return rounded(results, *METRICS, "ece", "temperature")


@query("feature_importance", "M12", "D24")
def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = labelled(spark, sf_dir)
    model = fit.fit_trees(splits["train"], "time_class", CLASSES, TEXT_FEATURES)
    shares = judge.normalised_share(model.importance(spark), "importance")
    return rounded(fit.top_importances(shares), "importance")


@query("normalised_importance", "D24", sql=with_views(
    f"""{_FEATURES}, i AS (UNPIVOT (SELECT language, {', '.join(
        f'sum({f}) AS {f}' for f in TEXT_FEATURES)} FROM feats GROUP BY language)
      ON COLUMNS(* EXCLUDE language) INTO NAME feature VALUE importance)
    SELECT language, feature, round(importance / sum(importance) OVER (PARTITION BY language), 6)
      AS importance FROM i""", "corpus"))
def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = text_features(corpus(spark, sf_dir)).groupBy("language").agg(
        *[F.sum(f).alias(f) for f in TEXT_FEATURES]
    )
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in TEXT_FEATURES]
    )
    return rounded(
        judge.normalised_share(sums.select("language", F.inline(cells)), "importance", ["language"]),
        "importance",
    )


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("feature_scales", "D23", sql="""SELECT feature, round(greatest(s, 0.5), 6) AS scale FROM (
  UNPIVOT (SELECT {} FROM lineitem) ON COLUMNS(*) INTO NAME feature VALUE s)""".format(
    ", ".join(f"stddev_pop({c}) AS {c}" for c in _LINE)))
def _scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serve.feature_scales(table(spark, sf_dir, "lineitem"), _LINE), "scale")


# Weights of the attribution query: importances of a fitted model, kept fixed here.
_WEIGHTS = {"n_chars": 0.3, "n_lines": 0.2, "n_words": 0.15, "n_capitals": 0.15, "n_digits": 0.0,
            "n_marks": 0.12, "n_stops": 0.08}


@query("top_contributions", "W8", "D23", sql=with_views(
    f"""{_FEATURES}, s AS (SELECT {', '.join(
        f'greatest(stddev_pop({f}), 0.5) AS {f}' for f in TEXT_FEATURES if f != 'n_stops')}
      FROM feats), c AS ({' UNION ALL '.join(
        f"SELECT solution_id, '{f}' AS feature, {i} AS place, {_WEIGHTS[f]} * (feats.{f} / "
        + (f"s.{f}" if f != 'n_stops' else '1.0') + ") AS v FROM feats, s"
        for i, f in enumerate(TEXT_FEATURES))})
    SELECT solution_id, feature, round(v, 6) AS contribution,
      row_number() OVER (PARTITION BY solution_id ORDER BY abs(v) DESC, place)::INT AS rank
    FROM c WHERE abs(v) >= 1e-9
    QUALIFY row_number() OVER (PARTITION BY solution_id ORDER BY abs(v) DESC, place) <= 5""",
    "corpus"))
def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = text_features(corpus(spark, sf_dir)).drop("code")
    # one feature has no recorded scale and takes the default of 1
    scaled = [f for f in TEXT_FEATURES if f != "n_stops"]
    scales = serve.feature_scales(frame, scaled).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "scale"))).alias("m")
    )
    weights = F.create_map(*[F.lit(x) for pair in _WEIGHTS.items() for x in pair])
    ranked = frame.withColumn("scales", scales.scalar())
    top = serve.top_contributions(ranked, TEXT_FEATURES, weights, F.col("scales"))
    return ranked.select("solution_id", F.posexplode(top).alias("place", "c")).select(
        "solution_id", "c.feature", "c.contribution", (F.col("place") + 1).alias("rank")
    )


_COSTS = {
    ("A", "ECONOMY", "F"): ("O(n)", "O(1)"), ("A", "ECONOMY", "O"): ("O(n log n)", "O(n)"),
    ("N", "PROMO", "F"): ("O(log n)", "O(1)"), ("R", "LARGE", "O"): ("O(n)", "O(n)"),
    ("R", "SMALL", "F"): ("O(1)", "O(1)"),
}


@query("library_cost_enrichment", "J9", sql="""
  WITH c(l, t, r, cost, allocation) AS (VALUES {})
  SELECT l_orderkey, coalesce(cost, 'O(1)') AS cost, coalesce(allocation, 'O(1)') AS allocation,
    cost IS NULL AS assumed, count(*) AS calls
  FROM lineitem JOIN part ON l_partkey = p_partkey
  LEFT JOIN c ON l_returnflag = l AND p_type = t AND l_linestatus = r GROUP BY 1, 2, 3, 4""".format(
    ", ".join(str((*k, *v)) for k, v in _COSTS.items())))
def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(
        "l_orderkey", F.col("l_returnflag").alias("language"), F.col("p_type").alias("call"),
        F.col("l_linestatus").alias("receiver"),
    )
    return serve.library_costs(calls, _COSTS).groupBy(
        "l_orderkey", "cost", "allocation", "assumed"
    ).agg(F.count(F.lit(1)).alias("calls"))
