"""Registered queries: text variants, augmentation, invariance and padding survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions import variants as texts
from rankwell.operators import variants
from rankwell.plans.adapters import corpus, table, with_views
from rankwell.plans.catalog import query
from rankwell.plans.judging_queries import rounded

_LANGUAGES = {"en": "python", "fr": "cpp", "de": "go", "es": "kotlin"}


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with program languages in place of the four text languages.

    Blank-led and indented lines are derived from the text so every rule is met.
    """
    frame = corpus(spark, sf_dir)
    language = F.element_at(
        F.create_map(*[F.lit(x) for pair in _LANGUAGES.items() for x in pair]), F.col("language")
    )
    code = F.concat(F.col("code"), F.lit("\n   # tail  \n\n  x = 1 \\\n"))
    return frame.withColumn("language", language).withColumn("code", code)


_PROGRAMS = """programs AS (SELECT * REPLACE (
    CASE language WHEN 'en' THEN 'python' WHEN 'fr' THEN 'cpp' WHEN 'de' THEN 'go' ELSE 'kotlin'
      END AS language,
    code || chr(10) || '   # tail  ' || chr(10) || chr(10) || '  x = 1 \\' || chr(10) AS code)
  FROM corpus),
 split AS (SELECT *, string_split(code[:-2], chr(10)) AS ls,
    CASE WHEN language = 'python' THEN '#' ELSE '//' END AS mk FROM programs)"""


def _pad_sql(k: int) -> str:
    return f"""CASE WHEN language <> 'kotlin' THEN array_to_string(list_concat(list_transform(range({k}),
      lambda i: CASE language WHEN 'cpp' THEN 'int ' ELSE '' END || 'pad' || i ||
        CASE language WHEN 'go' THEN ' := ' ELSE ' = ' END ||
        CASE WHEN i = 0 THEN '0' ELSE 'pad' || (i - 1) || ' + 1' END ||
        CASE language WHEN 'cpp' THEN ';' ELSE '' END), ls), chr(10)) || chr(10) END"""


_COMMENTS = f"""array_to_string(list_concat([mk || ' {texts.HEADER}'], list_transform(ls, lambda l:
  CASE WHEN trim(l) = '' OR l LIKE '%\\' OR (language = 'cpp' AND starts_with(trim(l), '#'))
    OR starts_with(trim(l), mk) THEN l ELSE l || '  ' || mk || ' note' END)), chr(10)) || chr(10)"""
_REFORMAT = """array_to_string(list_transform(ls, lambda l: CASE WHEN language = 'python'
  THEN repeat(' ', 2 * (length(rtrim(l)) - length(trim(l)))) || trim(l) ELSE trim(l) END),
  chr(10)) || chr(10)"""
_HELPER = "CASE language " + " ".join(
    "WHEN '{}' THEN {}".format(
        lang, " || chr(10) || ".join(f"'{p}'" for p in text.split("\n"))
    )
    for lang, text in texts.HELPERS.items() if lang in ("python", "cpp")
) + " END || code"
_VARIANTS = f"""{_PROGRAMS}, expanded AS (
  SELECT source, solution_id, language, code, 'dead_code' AS variant, {_pad_sql(20)} AS text FROM split
  UNION ALL SELECT source, solution_id, language, code, 'dead_code_heavy', {_pad_sql(60)} FROM split
  UNION ALL SELECT source, solution_id, language, code, 'comments', {_COMMENTS} FROM split
  UNION ALL SELECT source, solution_id, language, code, 'reformat', {_REFORMAT} FROM split
  UNION ALL SELECT source, solution_id, language, code, 'unused_helper', {_HELPER} FROM split),
 changed AS (SELECT * FROM expanded WHERE text IS NOT NULL AND text <> code)"""


@query("text_variants", "V1", "V2", "E2", sql=with_views(
    f"""{_VARIANTS} SELECT source, solution_id, language, variant, sha256(text) AS text_hash
    FROM changed""", "corpus"))
def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.expand_variants(programs(spark, sf_dir)).select(
        "source", "solution_id", "language", "variant", F.sha2("text", 256).alias("text_hash")
    )


@query("benchmark_variants", "V1", sql="""
  SELECT item_id, 'dead_code' AS variant, sha256(array_to_string(list_concat(
    list_transform(range(20), lambda i: 'pad' || i || ' = ' || CASE WHEN i = 0 THEN '0'
      ELSE 'pad' || (i - 1) || ' + 1' END), string_split(text, chr(10))), chr(10)) || chr(10))
    AS text_hash FROM benchmark""")
def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("code"), F.lit("python").alias("language")
    )
    return variants.expand_variants(items, ["dead_code"]).select(
        "item_id", "variant", F.sha2("text", 256).alias("text_hash")
    )


def _shouted(code: Column, language: Column) -> Column:
    return F.when(language != "go", F.translate(code, "aeiou", "AEIOU"))


@query("variant_registry", "E2", sql=with_views(
    f"""{_PROGRAMS} SELECT solution_id, 'shouted' AS variant, sha256(translate(code, 'aeiou', 'AEIOU')) AS text_hash
    FROM programs WHERE language <> 'go' AND translate(code, 'aeiou', 'AEIOU') <> code""", "corpus"))
def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = texts.available_variants()
    if "shouted" not in known:
        texts.register_variant("shouted", _shouted)
    try:
        rows = variants.expand_variants(programs(spark, sf_dir), ["shouted"])
    finally:
        if "shouted" not in known:
            del texts._variants["shouted"]
    return rows.select("solution_id", "variant", F.sha2("text", 256).alias("text_hash"))


@query("augmentation_union", "U2", sql=with_views(
    f"""{_PROGRAMS}, labelled AS (SELECT *, row_number() OVER (ORDER BY input_pos) - 1 AS i
      FROM split WHERE time_class IS NOT NULL)
    SELECT source, solution_id, language, sha256(code) AS code_hash FROM labelled UNION ALL
    SELECT source, solution_id || CASE i % 2 WHEN 0 THEN '+pad10' ELSE '+pad40' END, language,
      sha256(CASE i % 2 WHEN 0 THEN {_pad_sql(10)} ELSE {_pad_sql(40)} END) FROM labelled
    WHERE language <> 'kotlin'""", "corpus"))
def _augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = programs(spark, sf_dir).filter(F.col("time_class").isNotNull())
    return variants.augment(labelled).select(
        "source", "solution_id", "language", F.sha2("code", 256).alias("code_hash")
    )


# ----------------------------------------------------------------------- survival
def by_length(code: Column, language: Column) -> Column:
    """A predictor that padding fools: class by the length of the text."""
    size = F.length(code)
    return F.struct(
        F.when(size < 700, "O(1)").when(size < 1500, "O(n)").otherwise("O(n^2)").alias("time"),
        F.when(code.contains("  "), "O(n)").otherwise("O(1)").alias("space"),
        F.when(size > 20000, "ValueError: too long").alias("error"),
    )


def by_words(code: Column, language: Column) -> Column:
    """A predictor padding cannot fool: class by words the filler never has."""
    hit = F.lower(code).contains("the")
    return F.struct(
        F.when(hit, "O(n)").when(F.length(code) > 100, "O(1)").alias("time"),
        F.when(hit, "O(1)").alias("space"),
        F.lit(None).cast("string").alias("error"),
    )


def _length_sql(text: str) -> str:
    return f"""CASE WHEN length({text}) < 700 THEN 'O(1)' WHEN length({text}) < 1500 THEN 'O(n)'
      ELSE 'O(n^2)' END || CASE WHEN contains({text}, '  ') THEN 'O(n)' ELSE 'O(1)' END"""


def _words_sql(text: str) -> str:
    return f"""CASE WHEN contains(lower({text}), 'the') THEN 'O(n)O(1)'
      WHEN length({text}) > 100 THEN 'O(1)-' END"""


@query("padding_survival", "D22", sql=with_views(
    f"""{_PROGRAMS}, p AS (SELECT code, language, 10 AS size, {_pad_sql(10)} AS text FROM split
      UNION ALL SELECT code, language, 40, {_pad_sql(40)} FROM split),
    a AS (SELECT 'by_length' AS predictor, size, {_length_sql('code')} AS old,
        {_length_sql('text')} AS new FROM p WHERE text IS NOT NULL UNION ALL
      SELECT 'by_words', size, {_words_sql('code')}, {_words_sql('text')} FROM p
        WHERE text IS NOT NULL)
    SELECT predictor, size, count_if(old IS NOT DISTINCT FROM new)::BIGINT AS same,
      count(*) AS total FROM a WHERE old IS NOT NULL GROUP BY 1, 2""", "corpus"))
def _survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.padding_survival(
        programs(spark, sf_dir), {"by_length": by_length, "by_words": by_words}
    )


@query("twin_join", "J6", sql=with_views(
    f"""{_PROGRAMS}, t AS (SELECT 10 AS size, {_length_sql('code')} AS old,
        {_length_sql('(' + _pad_sql(10) + ')')} AS new FROM split WHERE language <> 'kotlin'
      UNION ALL SELECT 40, {_length_sql('code')}, {_length_sql('(' + _pad_sql(40) + ')')}
        FROM split WHERE language <> 'kotlin')
    SELECT size, count_if(old = new)::BIGINT AS same, count(*) AS total,
      round(count_if(old = new) / count(*), 6) AS unchanged_share FROM t GROUP BY size""",
    "corpus"))
def _twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = programs(spark, sf_dir)

    def answered(frame: DataFrame) -> DataFrame:
        return frame.select(
            "solution_id", by_length(F.col("code"), F.col("language")).alias("p")
        ).select("solution_id", "p.time", "p.space")

    copies = variants.pad_records(base, 10).unionByName(variants.pad_records(base, 40))
    return rounded(variants.twin_survival(answered(base), answered(copies)), "unchanged_share")


_INVARIANT = f"""{_VARIANTS}, rows AS (SELECT solution_id, language, variant,
    length(text) <= 20000 AND {_length_sql('code')} = {_length_sql('text')} AS same
  FROM changed WHERE length(code) <= 20000)"""


@query("invariance_report", "D21", sql=with_views(
    f"""{_INVARIANT} SELECT 'overall' AS scope, 'all' AS key, count(*) AS n,
      count_if(same)::BIGINT AS unchanged, round(avg(same::INT), 6) AS rate FROM rows
    UNION ALL SELECT 'variant', variant, count(*), count_if(same)::BIGINT,
      round(avg(same::INT), 6) FROM rows GROUP BY variant
    UNION ALL SELECT 'language', language, count(*), count_if(same)::BIGINT,
      round(avg(same::INT), 6) FROM rows GROUP BY language""", "corpus"))
def _invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.invariance_rows(programs(spark, sf_dir), by_length)
    return rounded(variants.invariance_report(rows), "rate")


@query("invariance_flips", "D21", sql=with_views(
    f"{_INVARIANT} SELECT solution_id, language, variant FROM rows WHERE NOT same", "corpus"))
def _flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.flips(variants.invariance_rows(programs(spark, sf_dir), by_length))
