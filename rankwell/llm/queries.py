"""The registered queries of the subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.bpe import round_trip_digests
from rankwell.llm.common import table
from rankwell.llm.conversation_repair import repair_digests
from rankwell.llm.extract import extract_pages
from rankwell.llm.hard_negatives import mined_negatives
from rankwell.llm.langid import identified_documents
from rankwell.llm.line_dedup import dedup_lines
from rankwell.llm.ngram_join import near_duplicates
from rankwell.llm.packing import pack_documents
from rankwell.llm.pii import span_digests
from rankwell.llm.recipe_dedup import exact_duplicates
from rankwell.llm.repair_sql import CONVERSATION_REPAIR
from rankwell.llm.sharding import shard_documents
from rankwell.llm.topk_search import top_k
from rankwell.llm.toxicity import toxic_documents

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), report="report").select(
        "doc_id", F.col("report.n_lines").alias("n_lines"), F.col("report.n_removed").alias("n_removed"),
        "text",
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return round_trip_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified_documents(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined_negatives(table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_line_dedup, op2_ngram_join, op3_exact_dedup, op4_topk_search, op5_byte_bpe,
        op6_best_fit_packing, op7_toxicity, op8_language_id, op9_sharding, op10_html_extraction,
        op11_conversation_repair, op12_hard_negatives, op13_pii,
    )
}

ORACLES: dict[str, str] = {
    "op11_conversation_repair": CONVERSATION_REPAIR,
    # equal without white space; sha256 of the normalised text
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(length(text), 0) AS n,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents
        ), ranked AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY body) AS group_size
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM ranked
    """,
    # a line goes if an earlier one shares 3/4 of the union of their shingles
    "op1_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS no,
                unnest(string_split(text, chr(10))) AS line
            FROM documents
        ), w AS (
            SELECT doc_id, no, line,
                list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM l
        ), s AS (
            SELECT doc_id, no, line, CASE WHEN len(ws) = 0 THEN []
                WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3),
                    lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS toks
            FROM w
        ), sets AS (
            SELECT toks, min((doc_id, no)) AS rep, len(toks) AS n FROM s WHERE len(toks) > 0 GROUP BY toks
        ), t AS (
            SELECT rep, n, unnest(toks) AS tok FROM sets
        ), p AS (
            SELECT b.rep AS later FROM t a JOIN t b ON a.tok = b.tok AND a.rep < b.rep
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 7 * count(*) >= 3 * (a.n + b.n)
        ), stay AS (
            SELECT rep FROM sets WHERE rep NOT IN (SELECT later FROM p)
        ), k AS (
            SELECT doc_id, no, line, len(toks) = 0 OR (doc_id, no) IN (SELECT rep FROM stay) AS stays FROM s
        )
        SELECT doc_id, count(*)::INTEGER AS n_lines, count_if(NOT stays)::INTEGER AS n_removed,
            coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '') AS text
        FROM k GROUP BY doc_id
    """,
    # components of the links of at least 3/4, by reachability
    "op2_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 3),
                    lambda i: array_to_string(ws[i:i + 4], ' '))) END AS toks
            FROM w
        ), t AS (
            SELECT doc_id, len(toks) AS n, unnest(toks) AS tok FROM s
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT s.doc_id, len(s.toks) AS n_shingles, m.component_id
        FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id
    """,
    "op4_topk_search": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), r AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM r
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
    # all pairs of an anchor and a row; windows of the first five of its label
    "op12_hard_negatives": r"""
        WITH v AS (
            SELECT row_number() OVER () AS r, * FROM (
                SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
                FROM embeddings
                WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            )
        ), s AS (
            SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r AS other, c.vec_id, a.label = c.label AS same,
                list_dot_product(a.e, c.e)::BIGINT AS score
            FROM v a JOIN v c ON a.r <> c.r AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0
        ), p AS (
            SELECT anchor, anchor_id, other AS positive, vec_id AS positive_id, score AS positive_score
            FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score,
            s.score AS negative_score
        FROM p JOIN s ON s.anchor = p.anchor AND NOT same
            AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
        WINDOW w AS (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER w <= 3
    """,
}
