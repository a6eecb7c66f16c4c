"""Views of the driver tables in the shapes the operators work on.

Each view exists twice: as a DataFrame and as a SQL text for the oracle.
Nothing is invented; every row derives from the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.hashing import stable_bucket
from rankwell.functions.ordinal import class_array, class_at, rank_of

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
DIMENSION_CLASSES = {"time": PRIORITIES, "space": SEGMENTS}
SCORE_CLASSES = tuple(f"c{i}" for i in range(10))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(ts: str = "ts") -> Column:
    """A zone-free timestamp column as an instant, whatever the session's time zone."""
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")
    return F.timestamp_micros(micros)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", utc())


# ----------------------------------------------------------------------- corpus
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("input_pos"),
        F.floor(F.col("doc_id") / 100).cast("string").alias("problem_id"),
        F.col("doc_id").cast("string").alias("solution_id"),
        "source",
        F.col("lang").alias("language"),
        F.col("text").alias("code"),
        F.col("quality").cast("string").alias("time_class"),
        F.col("toxic").cast("string").alias("space_class"),
    )


# ---------------------------------------------------------------------- answers
def answers_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case: labels, and two predictors' answers in both dimensions."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    key = F.col("o_orderkey").cast("string")
    bucket = stable_bucket(key, 1000)
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.withColumn("b", bucket).select(
        F.col("o_orderkey").alias("case_id"),
        F.col("n_name").alias("language"),
        F.element_at(
            F.create_map(
                F.lit("F"), F.lit("certain"), F.lit("O"), F.lit("assumed"),
                F.lit("P"), F.lit("unknown"),
            ),
            F.col("o_orderstatus"),
        ).alias("certainty"),
        "b",
        F.col("o_orderpriority").alias("label_time"),
        F.when(F.col("b") % 11 != 0, F.col("c_mktsegment")).alias("label_space"),
        class_at(F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)), PRIORITIES).alias(
            "rule_time"
        ),
        class_at(F.col("b") % 5, SEGMENTS).alias("rule_space"),
        _shifted("o_orderpriority", PRIORITIES, 550, 17).alias("model_time"),
        _shifted("c_mktsegment", SEGMENTS, 400, 19).alias("model_space"),
    )


def _shifted(label: str, classes: tuple[str, ...], right: int, gap: int) -> Column:
    shift = F.when(F.col("b") < right, 0).otherwise(F.col("b") % 5)
    rank = (rank_of(F.col(label), classes) + shift) % 5
    return F.when(F.col("b") % gap != 0, class_at(rank, classes))


ANSWERS_WIDE_SQL = f"""
answers_wide AS (
  SELECT case_id, language, certainty, b, label_time, label_space,
    {list(PRIORITIES)}[least(floor(price / 100000)::INT, 4) + 1] AS rule_time,
    {list(SEGMENTS)}[(b % 5)::INT + 1] AS rule_space,
    CASE WHEN b % 17 <> 0 THEN {list(PRIORITIES)}[
      ((list_position({list(PRIORITIES)}, label_time) - 1
        + CASE WHEN b < 550 THEN 0 ELSE b % 5 END) % 5)::INT + 1] END AS model_time,
    CASE WHEN b % 19 <> 0 THEN {list(SEGMENTS)}[
      ((list_position({list(SEGMENTS)}, segment) - 1
        + CASE WHEN b < 400 THEN 0 ELSE b % 5 END) % 5)::INT + 1] END AS model_space
  FROM (
    SELECT o_orderkey AS case_id, n_name AS language, o_totalprice AS price,
      CASE o_orderstatus WHEN 'F' THEN 'certain' WHEN 'O' THEN 'assumed'
        WHEN 'P' THEN 'unknown' END AS certainty,
      ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 1000 AS b,
      o_orderpriority AS label_time, c_mktsegment AS segment,
      CASE WHEN ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 1000 % 11 <> 0
        THEN c_mktsegment END AS label_space
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey))
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per case, dimension and predictor."""
    wide = answers_wide(spark, sf_dir)
    cells = [
        F.struct(
            F.lit(dimension).alias("dimension"),
            F.lit(predictor).alias("predictor"),
            F.col(f"label_{dimension}").alias("label"),
            F.col(f"{predictor}_{dimension}").alias("answer"),
        )
        for dimension in ("time", "space")
        for predictor in ("rule", "model")
    ]
    return wide.select(
        "case_id", "language", "certainty", F.inline(F.array(*cells))
    )


ANSWERS_SQL = ANSWERS_WIDE_SQL + """,
answers AS (
  SELECT case_id, language, certainty, 'time' AS dimension, 'rule' AS predictor,
    label_time AS label, rule_time AS answer FROM answers_wide
  UNION ALL SELECT case_id, language, certainty, 'time', 'model', label_time, model_time
    FROM answers_wide
  UNION ALL SELECT case_id, language, certainty, 'space', 'rule', label_space, rule_space
    FROM answers_wide
  UNION ALL SELECT case_id, language, certainty, 'space', 'model', label_space, model_space
    FROM answers_wide)
"""


# ----------------------------------------------------------------------- scores
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten raw scores per row, the true class, and a val/test side by hash.

    Float j of the whole vector is added to score j mod 10.
    """
    embeddings = table(spark, sf_dir, "embeddings")

    def folded(j: int) -> Column:
        mine = F.filter("embedding", lambda _, i: i % 10 == j)
        total = F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        return total * 8.0

    raw = F.array(*[folded(j) for j in range(10)])
    boosted = F.transform(
        raw, lambda x, i: x + F.when(i == F.col("label"), 1.5).otherwise(0.0)
    )
    return embeddings.select(
        F.col("vec_id").alias("id"),
        boosted.alias("scores"),
        F.element_at(class_array(SCORE_CLASSES), F.col("label") + 1).alias("true_label"),
        F.col("label").alias("true_rank"),
        F.when(stable_bucket(F.col("vec_id").cast("string")) < 50, "val")
        .otherwise("test")
        .alias("split"),
    )


SCORES_SQL = """
scores AS (
  SELECT vec_id AS id,
    [list_reduce(list_prepend(0.0::DOUBLE, [embedding[j + 1]::DOUBLE FOR j IN range(len(embedding))
        IF j % 10 = i]), lambda acc, x: acc + x) * 8.0 + CASE WHEN i = label THEN 1.5 ELSE 0.0 END
      FOR i IN range(10)] AS scores,
    'c' || label AS true_label, label AS true_rank,
    CASE WHEN ('0x' || substr(sha256(vec_id::VARCHAR), 1, 8))::BIGINT % 100 < 50
      THEN 'val' ELSE 'test' END AS split
  FROM embeddings)
"""

# ------------------------------------------------------------------------- tree
# One graph per user: root -> weeks -> days -> events.  Node ids are computed from
# (week, day, event id), so document order costs no sort and no window.
WEEK_BITS, DAY_BITS = 50, 46


def _tree_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.floor(F.unix_seconds("ts") / 86400)
    return (
        events(spark, sf_dir)
        .select(
            F.col("user_id").alias("graph_id"), "event_id", "event_type", "value", "props",
            days.alias("day_no"),
        )
        .select(
            "*",
            F.floor(F.col("day_no") / 7).alias("week"),
            (F.col("day_no") % 7).alias("day"),
        )
        .withColumn("week_id", F.shiftleft(F.col("week"), WEEK_BITS))
        .withColumn("day_id", F.col("week_id") + F.shiftleft(F.col("day") + 1, DAY_BITS))
        .withColumn("leaf_id", F.col("day_id") + F.col("event_id") + 1)
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node table (graph_id, node_id, symbol, span, text)."""
    events = _tree_events(spark, sf_dir)
    half = F.col("value") < 50
    kind = F.col("event_type")
    leaves = events.select(
        "graph_id",
        F.col("leaf_id").alias("node_id"),
        F.when(kind.isin("view", "click"), "IDENT")
        .when(kind == "purchase", "ARRAY_ALLOC")
        .when((kind == "signup") & half, "RECURSE")
        .when(kind == "signup", "SORT")
        .when(half, "BREAK")
        .otherwise("UNKNOWN")
        .alias("symbol"),
        F.col("week").cast("int").alias("line"),
        F.col("day").cast("int").alias("column"),
        F.concat(F.lit("v"), F.get_json_object("props", "$.k").cast("int") % 5).alias("text"),
    )
    days = events.groupBy("graph_id", "day_id").agg(
        F.max("week").cast("int").alias("line"), F.max("day").cast("int").alias("column")
    ).select(
        "graph_id",
        F.col("day_id").alias("node_id"),
        F.element_at(
            F.array(*map(F.lit, ("LOOP_HALVING", "LOOP_CONST_BOUND", "BRANCH", "FUNC_DEF"))),
            F.col("column") % 4 + 1,
        ).alias("symbol"),
        "line", "column",
        F.concat(F.lit("d"), F.col("column")).alias("text"),
    )
    weeks = events.groupBy("graph_id", "week_id").agg(
        F.max("week").cast("int").alias("line")
    ).select(
        "graph_id",
        F.col("week_id").alias("node_id"),
        F.lit("LOOP_N_BOUND").alias("symbol"),
        "line",
        F.lit(0).alias("column"),
        F.lit("w").alias("text"),
    )
    roots = events.groupBy("graph_id").agg(F.lit(0).cast("bigint").alias("node_id")).select(
        "graph_id", "node_id", F.lit("FUNC_DEF").alias("symbol"),
        F.lit(0).alias("line"), F.lit(0).alias("column"), F.lit("main").alias("text"),
    )
    return leaves.unionByName(days).unionByName(weeks).unionByName(roots)


def child_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AST_CHILD edges of :func:`nodes`."""
    events = _tree_events(spark, sf_dir)
    kind = F.lit("AST_CHILD").alias("kind")
    leaf = events.select(
        "graph_id", F.col("day_id").alias("src"), F.col("leaf_id").alias("dst"), kind
    )
    day = events.select(
        "graph_id", F.col("week_id").alias("src"), F.col("day_id").alias("dst"), kind
    ).distinct()
    week = events.select(
        "graph_id", F.lit(0).cast("bigint").alias("src"), F.col("week_id").alias("dst"), kind
    ).distinct()
    return leaf.unionByName(day).unionByName(week)


TREE_SQL = f"""
tree_events AS (
  SELECT user_id AS graph_id, event_id, event_type, value, props,
    week, day, (week << {WEEK_BITS}) AS week_id,
    (week << {WEEK_BITS}) + ((day + 1) << {DAY_BITS}) AS day_id,
    (week << {WEEK_BITS}) + ((day + 1) << {DAY_BITS}) + event_id + 1 AS leaf_id
  FROM (SELECT *, (epoch(ts)::BIGINT // 86400) // 7 AS week, (floor(epoch(ts) / 86400)::BIGINT) % 7 AS day
        FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events))),
nodes AS (
  SELECT graph_id, leaf_id AS node_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'IDENT'
      WHEN event_type = 'purchase' THEN 'ARRAY_ALLOC'
      WHEN event_type = 'signup' AND value < 50 THEN 'RECURSE'
      WHEN event_type = 'signup' THEN 'SORT'
      WHEN value < 50 THEN 'BREAK' ELSE 'UNKNOWN' END AS symbol,
    week::INT AS line, day::INT AS "column",
    'v' || ((props->>'$.k')::INT % 5) AS text FROM tree_events
  UNION ALL
  SELECT DISTINCT graph_id, day_id, ['LOOP_HALVING', 'LOOP_CONST_BOUND', 'BRANCH',
    'FUNC_DEF'][(day % 4)::INT + 1], week::INT, day::INT, 'd' || day FROM tree_events
  UNION ALL
  SELECT DISTINCT graph_id, week_id, 'LOOP_N_BOUND', week::INT, 0, 'w' FROM tree_events
  UNION ALL
  SELECT DISTINCT graph_id, 0::BIGINT, 'FUNC_DEF', 0, 0, 'main' FROM tree_events),
child_edges AS (
  SELECT graph_id, day_id AS src, leaf_id AS dst, 'AST_CHILD' AS kind FROM tree_events
  UNION ALL SELECT DISTINCT graph_id, week_id, day_id, 'AST_CHILD' FROM tree_events
  UNION ALL SELECT DISTINCT graph_id, 0::BIGINT, week_id, 'AST_CHILD' FROM tree_events)
"""


# ---------------------------------------------------------------------- samples
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth samples (series, n, time_ns, peak_bytes, max_call_depth)."""
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    return (
        lineitem.filter(F.col("l_quantity") >= 2)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("series"),
            F.col("l_quantity").cast("bigint").alias("n"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("time_ns"),
            F.round(F.col("l_quantity") * F.col("p_retailprice")).cast("bigint").alias(
                "peak_bytes"
            ),
            F.when(
                F.col("p_brand") != "Brand#1", F.floor(F.col("l_quantity") / 4).cast("bigint")
            ).alias("max_call_depth"),
        )
    )


SAMPLES_SQL = """
samples AS (
  SELECT p_brand AS series, l_quantity::BIGINT AS n,
    round(l_extendedprice * 100)::BIGINT AS time_ns,
    round(l_quantity * p_retailprice)::BIGINT AS peak_bytes,
    CASE WHEN p_brand <> 'Brand#1' THEN floor(l_quantity / 4)::BIGINT END AS max_call_depth
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 2)
"""

CORPUS_SQL = """
corpus AS (
  SELECT d.doc_id AS input_pos, (d.doc_id // 100)::VARCHAR AS problem_id,
    d.doc_id::VARCHAR AS solution_id, source, lang AS language, text AS code,
    quality::VARCHAR AS time_class, toxic::VARCHAR AS space_class
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

VIEWS = {
    "corpus": CORPUS_SQL,
    "answers_wide": ANSWERS_WIDE_SQL,
    "answers": ANSWERS_SQL,
    "scores": SCORES_SQL,
    "tree": TREE_SQL,
    "samples": SAMPLES_SQL,
}


def bucket_sql(key: str, buckets: int = 100) -> str:
    return f"(('0x' || substr(sha256({key}), 1, 8))::BIGINT % {buckets})"


def wide_bucket_sql(key: str) -> str:
    return f"(('0x' || substr(sha256({key}), 1, 12))::BIGINT)"


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the named views; it may go on with CTEs of its own."""
    head = ",\n".join(VIEWS[v].strip() for v in views)
    text = body.strip()
    if not head:
        return text
    glue = "\n" if text.upper().startswith("SELECT") else ",\n"
    return f"WITH RECURSIVE {head}{glue}{text}"
