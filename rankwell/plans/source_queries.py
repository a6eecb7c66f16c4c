"""Registered queries: corpus files, ingest joins, cases, lookups and request checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions import text
from rankwell.functions.expressions import expr_rejected, normalize_expr
from rankwell.functions.skew import numbered
from rankwell.operators import judge
from rankwell.operators.curate import with_split
from rankwell.plans.adapters import bucket_sql, corpus, table, with_views
from rankwell.plans.catalog import query
from rankwell.plans.curation_queries import NARROW, NARROW_SQL, SPLIT_SQL
from rankwell.plans.judging_queries import _CONTACT_LONG, first_contact
from rankwell.session import scratch_path
from rankwell.sources import calibration_file, cases, corpus_files, ingest

_HASHED = f"{NARROW_SQL}, sha256(code) AS code_hash"


def hashed(frame: DataFrame) -> DataFrame:
    return frame.select(*NARROW, F.sha2("code", 256).alias("code_hash"))


@query("corpus_scan", "S1", "S2", sql=with_views(f"SELECT {_HASHED} FROM corpus", "corpus"))
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "corpus") + ".jsonl"
    corpus_files.write_corpus(corpus(spark, sf_dir), path)
    return hashed(corpus_files.read_corpus(spark, path))


@query("corpus_scan_violations", "S1", sql=with_views(
    f"""SELECT count(*) AS lines, sum(({bucket_sql('solution_id')} % 10 = 0)::INT)::BIGINT AS
      lines_missing_a_key, sum(({bucket_sql('solution_id')} % 10 = 1)::INT)::BIGINT AS
      lines_with_an_unknown_key FROM corpus
      WHERE {bucket_sql('solution_id')} % 10 IN (0, 1)""", "corpus"))
def _scan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankwell.functions.hashing import stable_bucket

    bucket = stable_bucket(F.col("solution_id")) % 10
    fields = [F.col(f) for f in corpus_files.FIELDS]
    options = {"ignoreNullFields": "false"}
    line = (
        F.when(bucket == 0, F.to_json(F.struct(*fields[1:]), options))
        .when(bucket == 1, F.to_json(F.struct(*fields, F.lit(1).alias("extra")), options))
        .otherwise(F.to_json(F.struct(*fields), options))
    )
    path = scratch_path(spark, "broken")
    corpus(spark, sf_dir).select(line.alias("value")).write.text(path)
    return corpus_files.invalid_lines(spark, path).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.size("missing") > 0).alias("lines_missing_a_key"),
        F.count_if(F.size("unknown") > 0).alias("lines_with_an_unknown_key"),
    )


_PAGES = """pages_corpus AS (SELECT page_id::VARCHAR AS problem_id, page_id::VARCHAR AS
  solution_id, 'pages' AS source, 'html' AS language, html AS code, NULL AS time_class,
  NULL AS space_class FROM pages),
turns_corpus AS (SELECT conv_id::VARCHAR, conv_id || '_' || turn, 'conversations', role, text,
  NULL, NULL FROM conversations)"""


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("problem_id"),
        F.col("page_id").cast("string").alias("solution_id"),
        F.lit("pages").alias("source"), F.lit("html").alias("language"),
        F.col("html").alias("code"), none.alias("time_class"), none.alias("space_class"),
    )


def turns_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("problem_id"),
        F.concat_ws("_", "conv_id", "turn").alias("solution_id"),
        F.lit("conversations").alias("source"), F.col("role").alias("language"),
        F.col("text").alias("code"), none.alias("time_class"), none.alias("space_class"),
    )


@query("multi_file_load", "S3", "U1", sql=with_views(
    f"""{_PAGES}, u AS (SELECT *, 'a_documents.jsonl' AS file_name FROM (SELECT
      {NARROW_SQL}, code FROM corpus) UNION ALL BY NAME SELECT *, 'b_pages.jsonl' AS file_name
      FROM pages_corpus) SELECT file_name, {NARROW_SQL}, sha256(code) AS code_hash FROM u""",
    "corpus"))
def _multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "corpora")
    corpus_files.write_corpus(corpus(spark, sf_dir), f"{folder}/a_documents.jsonl")
    corpus_files.write_corpus(pages_corpus(spark, sf_dir), f"{folder}/b_pages.jsonl")
    corpus_files.write_corpus(turns_corpus(spark, sf_dir), f"{folder}/split_train.jsonl")
    loaded = corpus_files.load_corpora(spark, folder)
    return loaded.select("file_name", *NARROW, F.sha2("code", 256).alias("code_hash"))


@query("corpus_union", "U1", sql=with_views(
    f"""{_PAGES} SELECT {_HASHED} FROM corpus UNION ALL SELECT problem_id, solution_id,
      source, language, time_class, space_class, sha256(code) FROM pages_corpus""".replace(
        _HASHED, "problem_id, solution_id, source, language, time_class, space_class,"
        " sha256(code) AS code_hash"), "corpus"))
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = list(corpus_files.FIELDS)
    both = corpus(spark, sf_dir).select(*fields).unionByName(pages_corpus(spark, sf_dir))
    return hashed(both)


@query("nested_ingest", "S4", sql="""
  WITH s AS (SELECT conv_id, turn, 't' || (turn // 2) AS solution_id, text FROM conversations)
  SELECT conv_id::VARCHAR AS problem_id, solution_id, sha256(arg_max(text, turn)) AS code_hash
  FROM s GROUP BY 1, 2""")
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the nested file: rows of up to 64 turns of one conversation; every two turns share an id
    item = F.struct(
        "turn",
        F.concat(F.lit("t"), F.floor(F.col("turn") / 2)).alias("solution_id"),
        F.col("text").alias("solution_code"),
    )
    nested = (
        table(spark, sf_dir, "conversations")
        .groupBy(
            F.col("conv_id").cast("string").alias("problem_id"),
            F.floor(F.col("turn") / 64).alias("input_pos"),
        )
        .agg(F.array_sort(F.collect_list(item)).alias("correct_solution_list"))
    )
    path = scratch_path(spark, "nested")
    nested.write.json(path)
    schema = (
        "input_pos long, problem_id string, "
        "correct_solution_list array<struct<solution_id:string,solution_code:string>>"
    )
    flat = ingest.explode_solutions(spark.read.schema(schema).json(path))
    return flat.select("problem_id", "solution_id", F.sha2("code", 256).alias("code_hash"))


_WORDS = {"documents": {"en": "O(n)", "fr": "O(n^2)", "de": "O(1)"}}


@query("flat_ingest", "S5", "P1", sql="""
  SELECT source AS problem_id, source || '_text_' || doc_id AS solution_id,
    sha256(text) AS code_hash,
    CASE lang WHEN 'en' THEN 'O(n)' WHEN 'fr' THEN 'O(n^2)' ELSE 'O(1)' END AS time_class
  FROM documents WHERE lang <> 'es'""")
def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # row index = position in the file; documents are stored in doc_id order
    rows = numbered(
        table(spark, sf_dir, "documents").select(
            F.col("text").alias("src"), F.col("lang").alias("complexity"),
            F.col("source").alias("problem"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
        ),
        "file", "start",
    )
    records = ingest.flat_records(rows, "documents", "text", time_labels=_WORDS)
    return records.filter(F.col("time_class").isNotNull()).select(
        "problem_id", "solution_id", F.sha2("code", 256).alias("code_hash"), "time_class"
    )


@query("flat_ingest_counters", "S5", sql="""
  SELECT count_if(lang <> 'es')::BIGINT AS kept,
    count_if(lang = 'es')::BIGINT AS dropped_no_usable_label FROM documents""")
def _flat_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_index"), F.lit("").alias("src"),
        F.col("lang").alias("complexity"), F.col("source").alias("problem"),
    )
    records = ingest.flat_records(rows, "documents", "text", time_labels=_WORDS)
    return records.agg(
        F.count_if(F.col("time_class").isNotNull()).alias("kept"),
        F.count_if(F.col("time_class").isNull()).alias("dropped_no_usable_label"),
    )


_TIME = {"labels": {"1": "O(n)"}}
_SPACE = {"labels": {"0": "O(1)"}}
_JOINED = """d AS (SELECT doc_id, text FROM documents WHERE lang <> 'es'),
  j AS (SELECT l.doc_id, d.text AS code,
    CASE WHEN quality = 1 THEN 'O(n)' END AS time_class,
    CASE WHEN toxic = 0 AND l.doc_id % 7 <> 0 THEN 'O(1)' END AS space_class, quality, toxic
    FROM labels l LEFT JOIN d USING (doc_id))"""


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.floor(F.col("doc_id") / 100).cast("string").alias("problem_id"),
        F.col("doc_id").cast("string").alias("solution_id"),
        F.col("quality").cast("string").alias("time_complexity_inferred"),
        F.when(F.col("doc_id") % 7 != 0, F.col("toxic").cast("string")).alias(
            "space_complexity_inferred"
        ),
    )
    code = table(spark, sf_dir, "documents").filter(F.col("lang") != "es").select(
        F.floor(F.col("doc_id") / 100).cast("string").alias("problem_id"),
        F.col("doc_id").cast("string").alias("solution_id"),
        F.col("text").alias("code"),
    )
    return ingest.join_labels(labels, code, "labels", "text", _TIME, _SPACE)


@query("label_code_join", "J1", "P1", sql=f"""
  WITH {_JOINED} SELECT (doc_id // 100)::VARCHAR AS problem_id, doc_id::VARCHAR AS solution_id,
    time_class, space_class, sha256(code) AS code_hash FROM j
  WHERE code IS NOT NULL AND (time_class IS NOT NULL OR space_class IS NOT NULL)""")
def _label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_rows(spark, sf_dir).filter(F.col("outcome") == "kept").select(
        "problem_id", "solution_id", "time_class", "space_class",
        F.sha2("code", 256).alias("code_hash"),
    )


@query("label_code_join_counters", "J1", sql=f"""
  WITH {_JOINED} SELECT
    count_if(code IS NOT NULL AND (time_class IS NOT NULL OR space_class IS NOT NULL))::BIGINT
      AS kept,
    count_if(code IS NULL)::BIGINT AS missing_code,
    count_if(code IS NOT NULL AND time_class IS NULL AND space_class IS NULL)::BIGINT
      AS dropped_no_usable_label,
    0::BIGINT AS time_null, count_if(code IS NOT NULL AND quality = 0)::BIGINT AS time_unmapped,
    count_if(code IS NOT NULL AND doc_id % 7 = 0)::BIGINT AS space_null,
    count_if(code IS NOT NULL AND doc_id % 7 <> 0 AND toxic = 1)::BIGINT AS space_unmapped
  FROM j""")
def _label_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_counters(label_rows(spark, sf_dir))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest over benchmark items naming documents, some of which do not exist."""
    path = lambda k: F.concat(F.lit("doc/"), F.col("item_id") * 50 + k)
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item"), "item_id").alias("name"),
        F.lit("O(n)").alias("time_class"), F.lit("O(1)").alias("space_class"),
        F.create_map(F.lit("python"), path(0), F.lit("go"), path(7)).alias("path_by_language"),
    )


_MANIFEST = """m AS (SELECT 'item' || item_id AS name, x.language, item_id * 50 + x.k AS doc
  FROM benchmark, (VALUES ('python', 0), ('go', 7)) x(language, k))"""


@query("manifest_join", "S6", sql=f"""
  WITH {_MANIFEST} SELECT name AS problem_id, name || '_' || language AS solution_id, language,
    sha256(text) AS code_hash FROM m JOIN documents ON doc_id = doc""")
def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest_records(spark, sf_dir).filter(F.col("code").isNotNull()).select(
        "problem_id", "solution_id", "language", F.sha2("code", 256).alias("code_hash")
    )


def _manifest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("code")
    )
    wanted = ingest.manifest_paths(manifest(spark, sf_dir))
    return ingest.manifest_records(wanted, files, "manifest")


@query("manifest_missing_items", "S6", sql=f"""
  WITH {_MANIFEST} SELECT name AS problem_id, language, 'doc/' || doc AS path FROM m
  WHERE doc NOT IN (SELECT doc_id FROM documents)""")
def _manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest_records(spark, sf_dir).filter(F.col("code").isNull()).select(
        "problem_id", "language", "path"
    )


@query("catalogue_records", "S7", sql="""
  WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS host, html, url FROM pages)
  SELECT 'synth_' || page_id AS problem_id, 'synth_' || page_id || '_' || k AS solution_id,
    k AS language, sha256(CASE k WHEN 'html' THEN html WHEN 'url' THEN url ELSE host END)
    AS code_hash FROM p, (VALUES ('html'), ('url'), ('host')) v(k)""")
def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("name"),
        F.lit("O(n)").alias("time_class"), F.lit(None).cast("string").alias("space_class"),
        F.create_map(
            F.lit("html"), F.col("html"), F.lit("url"), F.col("url"), F.lit("host"), host
        ).alias("code_by_language"),
    )
    return ingest.catalogue_records(rows, "synth").select(
        "problem_id", "solution_id", "language", F.sha2("code", 256).alias("code_hash")
    )


@query("split_sinks", "S8", sql=with_views(
    f"SELECT {SPLIT_SQL} AS split, {_HASHED} FROM corpus", "corpus"))
def _split_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "splits")
    corpus_files.write_splits(
        with_split(corpus(spark, sf_dir)).select(*corpus_files.FIELDS, "split"), folder
    )
    schema = ", ".join(f"{f} string" for f in (*corpus_files.FIELDS, "split"))
    back = spark.read.schema(schema).json(folder)
    return back.select("split", *NARROW, F.sha2("code", 256).alias("code_hash"))


@query("write_once_evidence", "S9", sql=with_views(
    "SELECT certainty, count(*) AS n FROM answers_wide GROUP BY certainty", "answers_wide"))
def _write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "evidence")
    record = first_contact(spark, sf_dir)
    from rankwell.plans.adapters import answers_wide

    first = answers_wide(spark, sf_dir).select("case_id", "certainty")
    corpus_files.write_once(first, path)
    try:  # a second record is refused and the first one stays
        corpus_files.write_once(record.select("case_id", "certainty"), path)
        raise RuntimeError("the evidence was overwritten")
    except Exception as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
    return spark.read.parquet(path).groupBy("certainty").agg(F.count(F.lit(1)).alias("n"))


@query("calibration_lookup", "S10", "D13", "D15", sql=with_views(
    f"""{_CONTACT_LONG}, c AS (SELECT certainty, dimension,
        sum(coalesce((label = answer)::INT, 0))::BIGINT AS correct, count(*) AS total
      FROM long WHERE certainty IN ('certain', 'assumed') GROUP BY 1, 2)
    SELECT *, round((correct + 1) / (total + 2), 6) AS confidence FROM c""", "answers_wide"))
def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "calibration")
    levels = judge.certainty_levels(first_contact(spark, sf_dir))
    calibration_file.write_calibration(levels, path, "answers at first contact")
    rows = calibration_file.read_calibration(spark, path)
    return rows.withColumn("confidence", F.round("confidence", 6))


def golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases over the benchmark items, some of them broken on purpose."""
    item = F.col("item_id")
    source = lambda k: F.concat(F.lit(k), F.lit(" "), F.col("text"))
    core = F.create_map(
        *[x for lang in ("python", "cpp", "java", "javascript") for x in (F.lit(lang), source(lang))]
    )
    sources = F.when(item % 5 == 0, core).otherwise(
        F.map_concat(core, F.create_map(F.lit("go"), source("go")))
    )
    none = F.lit(None).cast("map<string,map<string,string>>")
    overrides = F.when(
        item % 4 == 0,
        F.create_map(F.lit("python"), F.create_map(F.lit("time_class"), F.lit("O(n^2)"))),
    ).when(
        item % 7 == 3,
        F.create_map(F.lit("rust"), F.create_map(F.lit("colour"), F.lit("red"))),
    ).otherwise(none)
    return table(spark, sf_dir, "benchmark").select(
        F.when(item % 11 == 0, F.concat(F.lit("Item"), item)).otherwise(
            F.concat(F.lit("item_"), F.floor(item / 2) * 2)
        ).alias("id"),
        F.lit("a case").alias("title"),
        F.concat(F.lit("g"), item % 3).alias("group"),
        F.array(F.when(item % 9 == 0, F.lit("known-limitation")).otherwise(F.lit("plain"))).alias(
            "tags"
        ),
        F.when(item % 13 == 1, "O(n^9)").otherwise("O(n)").alias("time_class"),
        F.lit("O(1)").alias("space_class"),
        F.when(item % 6 == 1, "n").otherwise("O(n)").alias("time_expr"),
        F.lit("O(1)").alias("space_expr"),
        F.when(item % 8 == 0, "the override differs").otherwise("plain").alias("rationale"),
        sources.alias("sources"),
        overrides.alias("overrides"),
    )


_CASES = """g AS (SELECT item_id AS i, CASE WHEN item_id % 11 = 0 THEN 'Item' || item_id
    ELSE 'item_' || (item_id // 2 * 2) END AS id, text FROM benchmark),
  langs AS (SELECT g.*, l.language FROM g, (VALUES ('python'), ('cpp'), ('java'), ('javascript'),
    ('go')) l(language) WHERE l.language <> 'go' OR i % 5 <> 0)"""


@query("golden_case_load", "S11", sql=f"""
  WITH {_CASES} SELECT id AS case_id, 'g' || (i % 3) AS "group", language,
    language || ' ' || text AS source,
    CASE WHEN i % 4 = 0 AND language = 'python' THEN 'O(n^2)'
      WHEN i % 13 = 1 THEN 'O(n^9)' ELSE 'O(n)' END AS time_class,
    'O(1)' AS space_class, CASE WHEN i % 6 = 1 THEN 'n' ELSE 'O(n)' END AS time_expr,
    'O(1)' AS space_expr, i % 4 = 0 OR i % 7 = 3 AS has_overrides,
    i % 9 = 0 AS known_limitation FROM langs""")
def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cases")
    golden_cases(spark, sf_dir).write.json(path)
    return cases.expected_by_language(cases.read_cases(spark, path))


@query("case_violations", "U3", sql=f"""
  WITH {_CASES}
  SELECT id, 'bad_id' AS rule, NULL AS detail FROM g WHERE i % 11 = 0
  UNION ALL SELECT id, 'bad_class', 'O(n^9)' FROM g WHERE i % 13 = 1
  UNION ALL SELECT id, 'bad_expression', 'n' FROM g WHERE i % 6 = 1
  UNION ALL SELECT id, 'missing_language', 'go' FROM g WHERE i % 5 = 0
  UNION ALL SELECT id, 'stray_override', 'rust' FROM g WHERE i % 7 = 3 AND i % 4 <> 0
  UNION ALL SELECT id, 'bad_override_field', 'colour' FROM g WHERE i % 7 = 3 AND i % 4 <> 0
  UNION ALL SELECT id, 'unexplained_override', NULL FROM g
    WHERE (i % 4 = 0 OR i % 7 = 3) AND i % 8 <> 0
  UNION ALL SELECT id, 'duplicate_id', count(*)::VARCHAR FROM g GROUP BY id HAVING count(*) > 1""")
def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.violations(golden_cases(spark, sf_dir))


# --------------------------------------------------------------------- text predicates
@query("request_validation", "P7", sql="""
  SELECT 'document' AS kind, doc_id AS id, CASE WHEN octet_length(encode(text)) > 4096
    THEN 'code exceeds the 4096-byte cap' WHEN lang NOT IN ('en', 'fr')
    THEN 'unsupported language: ''' || lang || '''' END AS reject_reason FROM documents
  UNION ALL SELECT 'page', page_id, CASE WHEN octet_length(encode(html)) > 4096
    THEN 'code exceeds the 4096-byte cap' END FROM pages""")
def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        text.reject_reason(F.col("text"), F.col("lang"), ("en", "fr"), 4096).alias("reject_reason"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        text.reject_reason(F.col("html"), F.lit("auto"), max_bytes=4096).alias("reject_reason"),
    )
    return documents.unionByName(pages)


_EXTENSIONS = {**text.LANGUAGE_OF_EXTENSION, ".html": "html"}


@query("language_by_extension", "P8", sql="""
  WITH n AS (SELECT page_id, regexp_extract(url, '[^/?#]+//[^?#]*?([^/?#]*)(?:[?#].*)?$', 1)
      || CASE page_id % 6 WHEN 0 THEN '.PY' WHEN 1 THEN '.cc' WHEN 2 THEN '.kts'
        WHEN 3 THEN '.zip' ELSE '' END AS name FROM pages)
  SELECT page_id, name, CASE page_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp'
      WHEN 2 THEN 'kotlin' WHEN 3 THEN NULL
      ELSE CASE WHEN name LIKE '%.html' AND name <> '.html' THEN 'html' END END AS language
  FROM n WHERE name NOT LIKE '.%'""")
def _extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.regexp_extract("url", r"[^/?#]+//[^?#]*?([^/?#]*)(?:[?#].*)?$", 1)
    tail = F.element_at(
        F.array(*map(F.lit, (".PY", ".cc", ".kts", ".zip", "", ""))),
        (F.col("page_id") % 6 + 1).cast("int"),
    )
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(base, tail).alias("name"))
    return named.filter(~F.col("name").startswith(".")).withColumn(
        "language", text.language_of_path(F.col("name"), _EXTENSIONS)
    )


@query("ordered_rule_classification", "P10", sql="""
  SELECT event_id, CASE WHEN event_type = 'view' THEN
      CASE WHEN event_id % 3 <= 1 THEN 'MATH_OP_LINEAR' ELSE 'MATH_OP_CONST' END
    WHEN event_type LIKE 'c%' THEN 'SORT' WHEN event_type LIKE '%k' THEN 'HEAP_PUSH'
    WHEN event_type LIKE 'p%' THEN 'HEAP_POP' ELSE 'CALL' END AS symbol
  FROM events WHERE event_type <> 'error'""")
def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = text.first_rule(
        F.col("event_type"), F.col("event_id") % 3,
        [("^(view|look)$", {"one": "MATH_OP_LINEAR", "many": "MATH_OP_CONST"})],
        [("^c", "SORT"), ("k$", "HEAP_PUSH"), ("^p", "HEAP_POP"), ("^error$", "")],
    )
    return table(spark, sf_dir, "events").select("event_id", symbol.alias("symbol")).filter(
        F.col("symbol").isNotNull()
    )


@query("trailing_segment", "P11", sql="""
  SELECT page_id, string_split(replace(regexp_extract(url, '//([^/]+)/', 1) ||
    CASE WHEN page_id % 2 = 0 THEN '->leaf' ELSE '' END, '->', '.'), '.')[-1] AS segment
  FROM pages""")
def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    name = F.concat(host, F.when(F.col("page_id") % 2 == 0, "->leaf").otherwise(""))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.trailing_segment(name).alias("segment")
    )


@query("expression_normalisation", "P19", sql="""
  SELECT p_partkey, CASE p_size % 7
    WHEN 0 THEN 'm*n' WHEN 1 THEN 'log(n)*n' WHEN 2 THEN 'm+n' WHEN 3 THEN '(m+n)*log(a+b)'
    WHEN 4 THEN '2^n*n' WHEN 5 THEN '(((((n)))))' ELSE NULL END AS normal,
    p_size % 7 = 6 AS rejected FROM part""")
def _normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    spellings = (
        "O(n * m)", "O(n log n)", " O(n+m) ", "O(log(b + a) * (n + m))", "O(n * 2^n)",
        "O((((((n))))))", "O((n) * m",
    )
    spelled = F.element_at(F.array(*map(F.lit, spellings)), F.col("p_size") % 7 + 1)
    return table(spark, sf_dir, "part").select(
        "p_partkey", normalize_expr(spelled).alias("normal"),
        expr_rejected(spelled).alias("rejected"),
    )


@query("request_log_lines", "X9", sql="""
  SELECT event_id, event_type AS event, user_id, (props->>'$.k')::INT AS k FROM events""")
def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    lines = events.select(
        "event_id",
        text.event_line(F.col("event_type"), [F.col("user_id"), k]).alias("line"),
    )
    parsed = F.from_json("line", "event string, user_id long, k int")
    return lines.select("event_id", parsed.alias("p")).select("event_id", "p.*")
