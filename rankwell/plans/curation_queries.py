"""Registered queries: hashing, dedupe, caps, splits, samples and corpus description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.hashing import record_key, split_name, stable_bucket, wide_bucket
from rankwell.operators import curate, describe
from rankwell.plans.adapters import (
    PRIORITIES,
    answers_wide,
    bucket_sql,
    corpus,
    table,
    wide_bucket_sql,
    with_views,
)
from rankwell.plans.catalog import query
from rankwell.plans.corpus_build import build_corpus

# Shape of a text for structure dedupe: one symbol per line length class, whole text.
def shaped(frame: DataFrame) -> DataFrame:
    """Add a signature over the line shape of the text, NULL for one-line texts."""
    lines = F.split("code", "\n")
    shape = F.transform(lines, lambda x: F.least(F.floor(F.length(x) / 400), F.lit(2)))
    return frame.withColumn(
        "signature", F.when(F.size(lines) > 1, F.sha2(F.array_join(shape, "|"), 256))
    )


SHAPED_SQL = """
shaped AS (
  SELECT *, CASE WHEN len(string_split(code, chr(10))) > 1 THEN sha256(array_to_string(
    list_transform(string_split(code, chr(10)), lambda x: least(length(x) // 400, 2)), '|')) END
    AS signature FROM corpus)
"""
SPLIT_SQL = (
    "CASE WHEN {b} < 70 THEN 'train' WHEN {b} < 85 THEN 'val' ELSE 'test' END".format(
        b=bucket_sql("source || ':' || problem_id")
    )
)
DEDUPED_SQL = """
deduped AS (SELECT * FROM corpus
  QUALIFY row_number() OVER (PARTITION BY source, code ORDER BY input_pos) = 1)
"""
HASH_ORDER_SQL = (
    f"{bucket_sql(chr(39).join(['source || ', ':', ' || solution_id']), 1000003)},"
    " source || ':' || solution_id"
)
NARROW = ["source", "problem_id", "solution_id", "language", "time_class", "space_class"]
NARROW_SQL = ", ".join(NARROW)


@query("stable_bucket", "X1", sql=with_views(
    f"""SELECT solution_id, {bucket_sql("source || ':' || solution_id")} AS bucket_100,
      {bucket_sql("source || ':' || solution_id", 1000003)} AS bucket_order,
      {wide_bucket_sql("source || ':' || solution_id")} AS bucket_wide FROM corpus""", "corpus"))
def _stable_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = record_key()
    return corpus(spark, sf_dir).select(
        "solution_id",
        stable_bucket(key).alias("bucket_100"),
        stable_bucket(key, 1_000_003).alias("bucket_order"),
        wide_bucket(key).alias("bucket_wide"),
    )


@query("problem_split", "X2", sql=with_views(
    f"SELECT solution_id, {SPLIT_SQL} AS split FROM corpus", "corpus"))
def _problem_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("solution_id", split_name().alias("split"))


@query("exact_dedupe", "W1", sql=with_views(
    f"{DEDUPED_SQL} SELECT {NARROW_SQL}, sha256(code) AS code_hash FROM deduped", "corpus"))
def _exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.exact_dedupe(corpus(spark, sf_dir)).select(
        *NARROW, F.sha2("code", 256).alias("code_hash")
    )


@query("corpus_build_report", "S8", "D1", "W1", "X2", sql=with_views(
    f"""{DEDUPED_SQL}, placed AS (SELECT *, {SPLIT_SQL} AS split FROM deduped)
    SELECT split, 'records' AS metric, 'all' AS class, count(*) AS n FROM placed GROUP BY split
    UNION ALL SELECT split, 'problems', 'all', count(DISTINCT (source, problem_id))
      FROM placed GROUP BY split
    UNION ALL SELECT split, 'time_class', coalesce(time_class, '<none>'), count(*)
      FROM placed GROUP BY 1, 3
    UNION ALL SELECT split, 'space_class', coalesce(space_class, '<none>'), count(*)
      FROM placed GROUP BY 1, 3""", "corpus"))
def _corpus_build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.split_report(build_corpus(corpus(spark, sf_dir)).drop("code"))


_FULL_BUILD = f"""{SHAPED_SQL}, one AS (SELECT * FROM shaped
    QUALIFY row_number() OVER (PARTITION BY source, code ORDER BY input_pos) = 1),
  two AS (SELECT * FROM one WHERE signature IS NULL UNION ALL
    (SELECT * FROM one WHERE signature IS NOT NULL
     QUALIFY row_number() OVER (PARTITION BY source, problem_id, signature, time_class,
       space_class ORDER BY {HASH_ORDER_SQL}) = 1)),
  three AS (SELECT * FROM two QUALIFY row_number() OVER (
    PARTITION BY source, problem_id ORDER BY {HASH_ORDER_SQL}) <= 2),
  four AS (SELECT * FROM three QUALIFY row_number() OVER (
    PARTITION BY time_class ORDER BY {HASH_ORDER_SQL}) <= 200)
"""


@query("corpus_build_all_reducers", "W1", "W2", "W3", "W4", "X2", sql=with_views(
    f"{_FULL_BUILD} SELECT {NARROW_SQL}, {SPLIT_SQL} AS split FROM four", "corpus"))
def _corpus_build_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_corpus(
        shaped(corpus(spark, sf_dir)),
        dedupe_structure=True, max_per_problem=2, max_per_class=200,
    ).select(*NARROW, "split")


@query("structure_dedupe", "W2", "X3", sql=with_views(
    f"""{SHAPED_SQL} SELECT {NARROW_SQL}, signature FROM shaped WHERE signature IS NULL
    UNION ALL (SELECT {NARROW_SQL}, signature FROM shaped WHERE signature IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source, problem_id, signature, time_class,
        space_class ORDER BY {HASH_ORDER_SQL}) = 1)""", "corpus"))
def _structure_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.structure_dedupe(shaped(corpus(spark, sf_dir)).drop("code")).select(
        *NARROW, "signature"
    )


@query("cap_per_problem", "W3", sql=with_views(
    f"""SELECT {NARROW_SQL} FROM corpus QUALIFY row_number() OVER (
      PARTITION BY source, problem_id ORDER BY {HASH_ORDER_SQL}) <= 2""", "corpus"))
def _cap_per_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.cap_per_problem(corpus(spark, sf_dir), 2).select(*NARROW)


@query("cap_per_class", "W4", sql=with_views(
    f"""SELECT {NARROW_SQL} FROM corpus QUALIFY row_number() OVER (
      PARTITION BY time_class ORDER BY {HASH_ORDER_SQL}) <= 40""", "corpus"))
def _cap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.cap_per_class(corpus(spark, sf_dir), 40).select(*NARROW)


@query("class_distribution", "D1", sql=with_views(
    """SELECT 'time' AS dimension, coalesce(time_class, '<none>') AS class, count(*) AS n
    FROM corpus GROUP BY 2 UNION ALL
    SELECT 'space', coalesce(space_class, '<none>'), count(*) FROM corpus GROUP BY 2""",
    "corpus"))
def _class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.class_distribution(corpus(spark, sf_dir))


@query("corpus_description", "D2", sql=with_views(
    """SELECT 'records' AS metric, 'all' AS key, count(*) AS value FROM corpus
    UNION ALL SELECT 'problems', 'all', count(DISTINCT (source, problem_id)) FROM corpus
    UNION ALL SELECT 'time_label_missing', 'all', count_if(time_class IS NULL)::BIGINT FROM corpus
    UNION ALL SELECT 'space_label_missing', 'all', count_if(space_class IS NULL)::BIGINT FROM corpus
    UNION ALL SELECT 'no_usable_label', 'all',
      count_if(time_class IS NULL AND space_class IS NULL)::BIGINT FROM corpus
    UNION ALL SELECT 'languages', language, count(*) FROM corpus GROUP BY language
    UNION ALL SELECT 'sources', source, count(*) FROM corpus GROUP BY source
    UNION ALL SELECT 'time_labels_by_language',
      language || '/' || coalesce(time_class, '<none>'), count(*) FROM corpus GROUP BY 2""",
    "corpus"))
def _corpus_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.corpus_description(corpus(spark, sf_dir))


@query("solutions_per_problem_profile", "D3", sql="""
  WITH sizes AS (SELECT count(*) AS s FROM orders GROUP BY o_custkey),
  l AS (SELECT list(s ORDER BY s) AS a FROM sizes)
  SELECT a[-1] AS max, a[(len(a) // 2 + 1)::INT] AS median, a[floor(len(a) * 0.95)::INT + 1] AS p95,
    len(list_filter(a, lambda x: x > 10))::BIGINT AS groups_over FROM l""")
def _group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.group_size_profile(table(spark, sf_dir, "orders"), ["o_custkey"], over=10)


@query("near_duplicate_share", "D4", "F1", sql=with_views(
    f"""{SHAPED_SQL}, chosen AS (SELECT * FROM shaped
      ORDER BY {wide_bucket_sql("source || ':' || solution_id")}, source, solution_id LIMIT 500),
    g AS (SELECT signature, count(*) AS c FROM chosen
      GROUP BY source, problem_id, signature, time_class, space_class)
    SELECT sum(c)::BIGINT AS sampled,
      coalesce(sum(c) FILTER (signature IS NULL), 0)::BIGINT AS unparsed,
      coalesce(sum(c - 1) FILTER (signature IS NOT NULL), 0)::BIGINT AS redundant_in_sample,
      round(coalesce(sum(c - 1) FILTER (signature IS NOT NULL), 0)
        / greatest(1, sum(c) - coalesce(sum(c) FILTER (signature IS NULL), 0)), 4)
        AS redundant_share FROM g""", "corpus"))
def _near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sample comes first: the signature is only computed for chosen rows
    return describe.near_duplicates(shaped(curate.hash_sample(corpus(spark, sf_dir), 500)))


def _status():
    return (
        F.when(F.length("code") < 60, "TooShort")
        .when(F.length("code") > 5000, "TooLong")
        .when(F.col("language") == "es", "unsupported")
        .otherwise("parsed")
    )


_STATUS_SQL = """CASE WHEN length(code) < 60 THEN 'TooShort' WHEN length(code) > 5000
  THEN 'TooLong' WHEN language = 'es' THEN 'unsupported' ELSE 'parsed' END"""


@query("parse_statistics", "D5", sql=with_views(
    f"""SELECT {SPLIT_SQL} AS split, count(*) AS total,
      count_if({_STATUS_SQL} = 'parsed')::BIGINT AS parsed,
      count_if({_STATUS_SQL} = 'unsupported')::BIGINT AS unsupported_language,
      count_if({_STATUS_SQL} NOT IN ('parsed', 'unsupported'))::BIGINT AS failed
    FROM corpus GROUP BY 1""", "corpus"))
def _parse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.parse_statistics(
        curate.with_split(corpus(spark, sf_dir)), _status(), ("split",)
    )


@query("parse_failure_types", "D5", sql=with_views(
    f"""SELECT {SPLIT_SQL} AS split, {_STATUS_SQL} AS failure, count(*) AS n FROM corpus
    WHERE {_STATUS_SQL} NOT IN ('parsed', 'unsupported') GROUP BY 1, 2""", "corpus"))
def _failure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.failure_types(curate.with_split(corpus(spark, sf_dir)), _status(), ("split",))


@query("split_leak_check", "D31", sql=with_views(
    f"""placed AS (SELECT *, {SPLIT_SQL} AS split FROM corpus)
    SELECT source, problem_id, min(split) AS first_split, max(split) AS last_split
    FROM placed GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""", "corpus"))
def _split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.split_leaks(curate.with_split(corpus(spark, sf_dir)))


@query("leaks_of_a_solution_split", "D31", sql=with_views(
    f"""placed AS (SELECT problem_id, source, CASE WHEN {bucket_sql('solution_id')} < 70
      THEN 'train' ELSE 'test' END AS split FROM corpus)
    SELECT source, problem_id, min(split) AS first_split, max(split) AS last_split
    FROM placed GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""", "corpus"))
def _solution_split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a split by solution instead of problem: the check must find its leaks
    wrong = F.when(stable_bucket(F.col("solution_id")) < 70, "train").otherwise("test")
    return describe.split_leaks(corpus(spark, sf_dir).withColumn("split", wrong))


@query("coverage_floors", "D30", sql=with_views(
    """need AS (SELECT * FROM (VALUES ('en', 100), ('fr', 100000000), ('de', 5), ('xx', 1))
      t(language, need)), have AS (SELECT language, count(*) AS have FROM corpus GROUP BY 1)
    SELECT language, coalesce(have, 0) AS have, need::BIGINT AS need FROM need LEFT JOIN have
    USING (language) WHERE coalesce(have, 0) < need""", "corpus"))
def _coverage_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    floors = {"en": 100, "fr": 100_000_000, "de": 5, "xx": 1}
    return describe.below_floor(corpus(spark, sf_dir), "language", floors)


# ---------------------------------------------------------------- label mapping, filters
_PRIORITY_VOCABULARY = {
    "orders": {"1-URGENT": "O(1)", "2-HIGH": "O(log n)", "3-MEDIUM": "O(n)", "5-LOW": "O(n^2)"}
}


@query("label_vocabulary_mapping", "P1", sql="""
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE
      CASE o_orderpriority WHEN '1-URGENT' THEN 'O(1)' WHEN '2-HIGH' THEN 'O(log n)'
        WHEN '3-MEDIUM' THEN 'O(n)' WHEN '5-LOW' THEN 'O(n^2)' END END AS class,
    CASE WHEN o_orderstatus = 'P' THEN 'unknown_source'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unmapped' ELSE 'ok' END AS class_status
  FROM orders""")
def _label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = F.when(F.col("o_orderstatus") == "P", "other").otherwise("orders")
    return curate.map_labels(
        table(spark, sf_dir, "orders"), "o_orderpriority", vocabulary,
        _PRIORITY_VOCABULARY, "class",
    ).select("o_orderkey", "class", "class_status")


@query("label_mapping_counters", "P1", sql="""
  SELECT count_if(o_orderpriority <> '4-NOT SPECIFIED')::BIGINT AS mapped,
    count_if(o_orderpriority = '4-NOT SPECIFIED')::BIGINT AS unmapped, 0::BIGINT AS missing
  FROM orders""")
def _label_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = curate.map_labels(
        table(spark, sf_dir, "orders"), "o_orderpriority", F.lit("orders"),
        _PRIORITY_VOCABULARY, "class",
    )
    status = F.col("class_status")
    return mapped.agg(
        F.count_if(status == "ok").alias("mapped"),
        F.count_if(status == "unmapped").alias("unmapped"),
        F.count_if(status == "null").alias("missing"),
    )


@query("label_present_filter", "P4", sql=with_views(
    f"SELECT {NARROW_SQL} FROM corpus WHERE time_class IS NOT NULL", "corpus"))
def _label_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.with_label(corpus(spark, sf_dir), "time_class").select(*NARROW)


@query("usable_audit_rows", "P5", sql=with_views(
    """SELECT case_id, kind, confidence FROM (SELECT case_id,
      CASE WHEN b % 3 = 0 THEN 'disagreement' ELSE 'random' END AS kind,
      CASE WHEN b % 4 = 0 THEN 'low' ELSE 'high' END AS confidence FROM answers_wide)
    WHERE kind = 'random' AND confidence <> 'low'""", "answers_wide"))
def _usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.usable(audit_entries(spark, sf_dir), "random").select(
        "case_id", "kind", "confidence"
    )


def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit table over the answers: corpus label, engine and agent readings."""
    return answers_wide(spark, sf_dir).select(
        "case_id",
        F.col("language").alias("source"),
        F.when(F.col("b") % 3 == 0, "disagreement").otherwise("random").alias("kind"),
        F.when(F.col("b") % 4 == 0, "low").otherwise("high").alias("confidence"),
        F.when(F.col("b") % 13 != 0, F.col("label_time")).alias("corpus_time"),
        F.col("rule_time").alias("engine_time"),
        F.col("model_time").alias("agent_time"),
        F.col("label_space").alias("corpus_space"),
        F.col("rule_space").alias("engine_space"),
        F.col("model_space").alias("agent_space"),
    )


@query("language_subset", "P6", sql=with_views(
    f"SELECT {NARROW_SQL} FROM corpus WHERE language IN ('en', 'fr')", "corpus"))
def _language_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.in_languages(corpus(spark, sf_dir), ["en", "fr"]).select(*NARROW)


# ------------------------------------------------------------------------------ samples
@query("hash_sample", "F1", sql=with_views(
    f"""SELECT {NARROW_SQL}, {wide_bucket_sql("source || ':' || solution_id")} AS bucket
    FROM corpus ORDER BY bucket, source, solution_id LIMIT 100""", "corpus"))
def _hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.hash_sample(corpus(spark, sf_dir), 100).select(*NARROW, "bucket")


@query("hash_sample_per_language", "F1", sql=with_views(
    f"""SELECT {NARROW_SQL}, {wide_bucket_sql("source || ':' || solution_id")} AS bucket
    FROM corpus WHERE (time_class IS NOT NULL OR space_class IS NOT NULL)
      AND language IN ('en', 'fr')
    QUALIFY row_number() OVER (PARTITION BY language ORDER BY bucket, source, solution_id)
      <= CASE language WHEN 'en' THEN 150 ELSE 50 END""", "corpus"))
def _hash_sample_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.hash_sample_per_language(corpus(spark, sf_dir), {"en": 150, "fr": 50}).select(
        *NARROW, "bucket"
    )


@query("quota_fill_slice", "F2", "W2", "W3", sql=with_views(
    f"""{SHAPED_SQL}, capped AS (SELECT * FROM shaped QUALIFY row_number() OVER (
      PARTITION BY source, problem_id ORDER BY {HASH_ORDER_SQL}) <= 2),
    slim AS (SELECT * FROM capped WHERE signature IS NULL UNION ALL
      (SELECT * FROM capped WHERE signature IS NOT NULL QUALIFY row_number() OVER (
       PARTITION BY source, problem_id, signature, time_class, space_class
       ORDER BY {HASH_ORDER_SQL}) = 1))
    SELECT {NARROW_SQL} FROM slim WHERE language <> 'en' UNION ALL
    (SELECT {NARROW_SQL} FROM slim WHERE language = 'en' QUALIFY row_number() OVER (
      ORDER BY {wide_bucket_sql("source || ':' || solution_id")}, source, solution_id)
      <= greatest(0, 300 - (SELECT count(*) FROM slim WHERE language <> 'en')))""", "corpus"))
def _quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = curate.cap_per_problem(shaped(corpus(spark, sf_dir)).drop("code"), 2)
    return curate.quota_fill(curate.structure_dedupe(capped), 300, "en").select(*NARROW)


@query("blind_sample", "F3", sql=with_views(
    f"""SELECT source, solution_id, language, sha256(code) AS code_hash FROM corpus
    WHERE time_class IS NOT NULL AND space_class IS NOT NULL
    ORDER BY {wide_bucket_sql("source || ':' || solution_id")}, source, solution_id LIMIT 120""",
    "corpus"))
def _blind_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unlabelled = curate.blind_sample(corpus(spark, sf_dir), 120)
    return unlabelled.select(
        "source", "solution_id", "language", F.sha2("code", 256).alias("code_hash")
    )


@query("known_class_semi_join", "J8", sql=with_views(
    f"""placed AS (SELECT *, {SPLIT_SQL} AS split FROM corpus), seen AS (
      SELECT DISTINCT problem_id AS c FROM placed WHERE split = 'train' AND source < 'src15')
    SELECT solution_id, problem_id FROM placed WHERE split = 'val' AND problem_id IN
      (SELECT c FROM seen)""", "corpus"))
def _known_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = curate.with_split(corpus(spark, sf_dir)).select(
        "solution_id", "problem_id", "split", "source"
    )
    trained = placed.filter((F.col("split") == "train") & (F.col("source") < "src15"))
    return curate.known_classes_only(
        placed.filter(F.col("split") == "val"), trained, "problem_id"
    ).select("solution_id", "problem_id")


_MARKERS = {"de": ("ein", "sch", "ber"), "en": ("the", "and", "tion"),
            "es": ("ci", "ado", "os"), "fr": ("eau", "eux", "tre")}


@query("language_by_fewest_errors", "P9", sql="""
  WITH counted AS (SELECT doc_id, m.language, length(text) - (
      length(text) - length(replace(text, m.a, '')) + length(text) - length(replace(text, m.b, ''))
      + length(text) - length(replace(text, m.c, ''))) AS errors
    FROM documents, (VALUES ('de', 'ein', 'sch', 'ber'), ('en', 'the', 'and', 'tion'),
      ('es', 'ci', 'ado', 'os'), ('fr', 'eau', 'eux', 'tre')) m(language, a, b, c))
  SELECT doc_id, arg_min(language, (errors, language)) AS language, min(errors)::BIGINT AS errors
  FROM counted GROUP BY doc_id""")
def _fewest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # misses = characters of the text not covered by a marker of the language
    def misses(words):
        covered = sum(
            (F.length("text") - F.length(F.replace("text", F.lit(w))) for w in words),
            F.lit(0),
        )
        return (F.length("text") - covered).cast("bigint")

    cells = F.array(
        *[
            F.struct(F.lit(lang).alias("language"), misses(words).alias("errors"))
            for lang, words in _MARKERS.items()
        ]
    )
    counts = table(spark, sf_dir, "documents").select("doc_id", F.inline(cells))
    return curate.language_by_fewest_errors(counts, "doc_id")
