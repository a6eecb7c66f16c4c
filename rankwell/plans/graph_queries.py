"""Registered queries: trees, derived edges, features, encodings, calls and messages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.ordinal import TIME_CLASSES, class_at
from rankwell.operators import graph, message
from rankwell.plans.adapters import child_edges, nodes, table, with_views
from rankwell.plans.catalog import query
from rankwell.session import written

_LOOPS = "('LOOP_CONST_BOUND', 'LOOP_N_BOUND', 'LOOP_HALVING')"
# The tree is three levels deep, so the oracle spells the walk out as a recursion.
_WALK = f"""kids AS (SELECT e.graph_id, e.src, e.dst, n.symbol, n.text FROM child_edges e
    JOIN nodes n ON e.graph_id = n.graph_id AND e.dst = n.node_id),
  walk AS (SELECT graph_id, node_id, symbol, text, 0 AS level, 0 AS loop_depth,
      NULL::BIGINT AS scope FROM nodes WHERE (graph_id, node_id) NOT IN
      (SELECT graph_id, dst FROM child_edges)
    UNION ALL
    SELECT k.graph_id, k.dst, k.symbol, k.text, level + 1,
      loop_depth + CASE WHEN w.symbol IN {_LOOPS} THEN 1 ELSE 0 END,
      CASE WHEN w.symbol = 'FUNC_DEF' THEN w.node_id ELSE scope END
    FROM walk w JOIN kids k ON w.graph_id = k.graph_id AND w.node_id = k.src)"""
_SIBLINGS = """siblings AS (SELECT * FROM (SELECT graph_id, dst AS src, lead(dst) OVER (
    PARTITION BY graph_id, src ORDER BY dst) AS dst, 'NEXT_SIBLING' AS kind FROM child_edges)
  WHERE dst IS NOT NULL)"""
_USES = """uses AS (SELECT * FROM (SELECT graph_id, node_id AS src, lead(node_id) OVER (
    PARTITION BY graph_id, scope, text ORDER BY node_id) AS dst, 'DATA_DEP' AS kind FROM walk
    WHERE symbol = 'IDENT' AND scope IS NOT NULL) WHERE dst IS NOT NULL)"""


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nodes(spark, sf_dir), child_edges(spark, sf_dir)


def stored_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tree as tables on disk, for operators that read it several times."""
    all_nodes, edges = tree(spark, sf_dir)
    return written(all_nodes, "nodes"), written(edges, "edges")


@query("tree_roots", "G3", sql=with_views(
    """SELECT graph_id, node_id, symbol FROM nodes
    WHERE (graph_id, node_id) NOT IN (SELECT graph_id, dst FROM child_edges)""", "tree"))
def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roots(*tree(spark, sf_dir)).select("graph_id", "node_id", "symbol")


@query("tree_children", "G3", sql=with_views(
    "SELECT graph_id, src, dst FROM child_edges", "tree"))
def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.children(child_edges(spark, sf_dir))


@query("tree_walk", "G4", sql=with_views(
    f"{_WALK} SELECT graph_id, node_id, symbol, level, loop_depth, scope FROM walk", "tree"))
def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(*stored_tree(spark, sf_dir)).drop("text")


_BELOW = """below AS (SELECT n.graph_id, n.node_id AS root, k.dst AS node_id, k.symbol, k.text,
      1 AS depth FROM nodes n JOIN kids k ON n.graph_id = k.graph_id AND n.node_id = k.src
      WHERE {of}
    UNION ALL
    SELECT b.graph_id, root, k.dst, k.symbol, k.text, depth + 1 FROM below b JOIN kids k
      ON b.graph_id = k.graph_id AND b.node_id = k.src {stop})"""


@query("transitive_closure", "G4", sql=with_views(
    f"""{_WALK}, {_BELOW.format(of=f"n.symbol IN {_LOOPS}", stop="")}
    SELECT graph_id, root, node_id, symbol, depth FROM below""", "tree"))
def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes, edges = stored_tree(spark, sf_dir)
    loops = all_nodes.filter(F.col("symbol").isin(*graph.LOOPS))
    return graph.descendants(all_nodes, edges, loops).drop("text")


@query("bounded_closure", "G4", sql=with_views(
    f"""{_WALK}, {_BELOW.format(of="n.symbol = 'FUNC_DEF'", stop="AND b.symbol <> 'FUNC_DEF'")}
    SELECT graph_id, root, node_id, symbol, depth FROM below""", "tree"))
def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes, edges = stored_tree(spark, sf_dir)
    functions = all_nodes.filter(F.col("symbol") == "FUNC_DEF")
    return graph.descendants(all_nodes, edges, functions, stop_symbol="FUNC_DEF").drop("text")


@query("loop_carry_edges", "G5", sql=with_views(
    f"""{_WALK}, {_BELOW.format(of=f"n.symbol IN {_LOOPS}", stop="")}
    SELECT graph_id, root AS src, node_id AS dst, 'LOOP_CARRY' AS kind FROM below
    WHERE symbol = 'IDENT' QUALIFY count(*) OVER (PARTITION BY graph_id, root, text) >= 2""",
    "tree"))
def _loop_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.loop_carry_edges(*stored_tree(spark, sf_dir))


@query("use_chain_edges", "W5", sql=with_views(f"{_WALK}, {_USES} SELECT * FROM uses", "tree"))
def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.data_dependency_edges(graph.walk(*stored_tree(spark, sf_dir)))


@query("sibling_edges", "W6", sql=with_views(f"{_SIBLINGS} SELECT * FROM siblings", "tree"))
def _sibling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sibling_edges(*tree(spark, sf_dir))


@query("turn_chain", "W6", sql="""
  SELECT * FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next
  FROM conversations) WHERE next IS NOT NULL""")
def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankwell.functions.skew import next_in_group

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    chained = next_in_group(turns, ["conv_id"], "turn", F.shiftright("turn", 2))
    return chained.filter(F.col("next").isNotNull()).select("conv_id", "turn", "next")


_FEATURES = f"""w AS (SELECT graph_id,
    coalesce(max(loop_depth + 1) FILTER (symbol IN {_LOOPS}), 0)::INT AS max_loop_nesting_depth,
    coalesce(max(loop_depth) FILTER (symbol = 'ARRAY_ALLOC'), 0)::INT AS max_alloc_nesting_depth,
    count_if(symbol IN {_LOOPS})::INT AS loop_count,
    count_if(symbol = 'ARRAY_ALLOC')::INT AS alloc_count,
    count_if(symbol = 'ARRAY_ALLOC' AND loop_depth > 0)::INT AS alloc_inside_loop_count,
    count_if(symbol = 'RECURSE')::INT AS recursion_call_count,
    count_if(symbol = 'BRANCH')::INT AS branch_count, count_if(symbol = 'BREAK')::INT AS break_count,
    0::INT AS continue_count, count_if(symbol = 'SORT')::INT AS sort_call_count,
    0::INT AS binary_search_call_count, 0::INT AS heap_op_count, 0::INT AS math_op_count,
    0::INT AS call_count, count(*)::INT AS node_count, {', '.join(
      f"count_if(symbol IN {_LOOPS} AND least(loop_depth, 3) = {d})::INT AS loop_count_depth_{d}"
      for d in range(4))} FROM walk GROUP BY graph_id),
  features AS (SELECT w.*, e.edge_count, CASE recursion_call_count WHEN 0 THEN 'none'
      WHEN 1 THEN 'single' ELSE 'multiple' END AS recursion_shape,
      (recursion_call_count = 0)::INT AS recursion_shape_none,
      (recursion_call_count = 1)::INT AS recursion_shape_single,
      (recursion_call_count > 1)::INT AS recursion_shape_multiple
    FROM w JOIN (SELECT graph_id, count(*)::INT AS edge_count FROM child_edges GROUP BY 1) e
    USING (graph_id))"""


@query("tabular_features", "G6", "X8", sql=with_views(
    f"{_WALK}, {_FEATURES} SELECT * FROM features", "tree"))
def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tabular_features(*stored_tree(spark, sf_dir))


_RULE = """rule AS (SELECT graph_id, ['O(1)', 'O(n)', 'O(n^2)', 'O(n^3)'][
    least(max_loop_nesting_depth, 3) + 1] AS rule_time, ['O(1)', 'O(n)', 'O(n^2)'][
    least(max_alloc_nesting_depth, 2) + 1] AS rule_space FROM features)"""


@query("rule_predictor", "P13", sql=with_views(
    f"{_WALK}, {_FEATURES}, {_RULE} SELECT * FROM rule", "tree"))
def _rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = graph.tabular_features(*stored_tree(spark, sf_dir))
    return graph.rule_prediction(features).select("graph_id", "rule_time", "rule_space")


@query("recursion_shape", "X8", sql=with_views(
    """c AS (SELECT graph_id, count_if(symbol = 'RECURSE')::INT AS recursion_call_count FROM nodes
      GROUP BY 1) SELECT *, CASE recursion_call_count WHEN 0 THEN 'none' WHEN 1 THEN 'single'
      ELSE 'multiple' END AS recursion_shape, (recursion_call_count = 0)::INT AS
      recursion_shape_none, (recursion_call_count = 1)::INT AS recursion_shape_single,
      (recursion_call_count > 1)::INT AS recursion_shape_multiple FROM c""", "tree"))
def _shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = nodes(spark, sf_dir).groupBy("graph_id").agg(
        F.count_if(F.col("symbol") == "RECURSE").cast("int").alias("recursion_call_count")
    )
    return graph.with_recursion_shape(counted)


# ------------------------------------------------------------------- encoding, re-indexing
_INDEX = """idx AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1
    AS position FROM nodes)"""


@query("graph_encoding", "G1", sql=with_views(
    f"""SELECT c_custkey AS graph_id, coalesce(node_id, 0) AS node_id,
      (list_position({list(graph.SYMBOLS)}, coalesce(symbol, 'UNKNOWN')) - 1)::INT AS symbol_id
    FROM customer LEFT JOIN nodes ON c_custkey = graph_id""", "tree"))
def _encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every customer is a graph; those without events get the placeholder node
    graphs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"))
    return graph.encoded_nodes(graphs, nodes(spark, sf_dir))


@query("global_reindexing", "G2", sql=with_views(
    f"""{_INDEX} SELECT graph_id, node_id, position, row_number() OVER (
      ORDER BY graph_id, node_id) - 1 AS global_id FROM idx""", "tree"))
def _global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.global_index(nodes(spark, sf_dir)).select(
        "graph_id", "node_id", "position", "global_id"
    )


@query("global_edges", "G2", sql=with_views(
    """g AS (SELECT graph_id, node_id, row_number() OVER (ORDER BY graph_id, node_id) - 1 AS i
      FROM nodes) SELECT e.graph_id, a.i AS src, b.i AS dst, e.kind FROM child_edges e
    JOIN g a ON e.graph_id = a.graph_id AND e.src = a.node_id
    JOIN g b ON e.graph_id = b.graph_id AND e.dst = b.node_id""", "tree"))
def _global_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes, edges = tree(spark, sf_dir)
    return graph.reindexed_edges(edges, graph.global_index(all_nodes), "global_id")


@query("structure_signature", "X3", sql=with_views(
    f"""{_INDEX}, items AS (SELECT graph_id, 'n|' || position || '|' || symbol AS item FROM idx
      UNION ALL SELECT e.graph_id, 'e|' || kind || '|' || a.position || '|' || b.position
      FROM child_edges e JOIN idx a ON e.graph_id = a.graph_id AND e.src = a.node_id
      JOIN idx b ON e.graph_id = b.graph_id AND e.dst = b.node_id),
    h AS (SELECT graph_id, sha256(item) AS h FROM items)
    SELECT graph_id, sha256({" || '|' || ".join(
      f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))})
      AS signature FROM h GROUP BY graph_id""", "tree"))
def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes, edges = tree(spark, sf_dir)
    placed = written(graph.local_index(all_nodes).select("graph_id", "node_id", "position", "symbol"), "placed")
    return graph.structure_signature(placed, graph.reindexed_edges(edges, placed, "position"))


@query("symbol_sequence_text", "X7", sql=with_views(
    f"""{_INDEX} SELECT graph_id, position // {graph.TEXT_SYMBOLS} AS piece,
      string_agg(symbol, ' ' ORDER BY position) AS text FROM idx GROUP BY 1, 2""", "tree"))
def _symbol_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symbol_text(graph.local_index(nodes(spark, sf_dir)))


@query("symbol_gram_counts", "X7", "M4", sql=with_views(
    f"""{_INDEX}, l AS (SELECT graph_id, symbol AS a, lead(symbol) OVER w AS b, lead(symbol, 2) OVER w AS c FROM idx
      WINDOW w AS (PARTITION BY graph_id ORDER BY position)),
    g AS (SELECT graph_id, a AS gram FROM l UNION ALL SELECT graph_id, a || ' ' || b FROM l WHERE b IS NOT NULL
      UNION ALL SELECT graph_id, a || ' ' || b || ' ' || c FROM l WHERE c IS NOT NULL)
    SELECT graph_id, gram, count(*) AS n FROM g GROUP BY 1, 2""", "tree"))
def _symbol_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symbol_grams(graph.local_index(nodes(spark, sf_dir)))


@query("symbol_histogram", "D27", sql=with_views(
    "SELECT graph_id, symbol, count(*) AS n FROM nodes GROUP BY 1, 2", "tree"))
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symbol_histogram(nodes(spark, sf_dir))


@query("graph_summary", "D27", sql=with_views(
    """h AS (SELECT graph_id, symbol, count(*) AS n FROM nodes GROUP BY 1, 2),
    e AS (SELECT graph_id, count(*) AS edges FROM child_edges GROUP BY 1)
    SELECT graph_id, sum(n)::BIGINT AS nodes, max(edges) AS edges,
      string_agg(symbol || '=' || n, ',' ORDER BY symbol) AS histogram
    FROM h JOIN e USING (graph_id) GROUP BY graph_id""", "tree"))
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = graph.graph_summary(*tree(spark, sf_dir))
    entries = F.transform(
        F.array_sort(F.map_entries("histogram")),
        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
    )
    return summary.withColumn("histogram", F.array_join(entries, ","))


@query("unknown_share_warning", "P12", sql=with_views(
    """SELECT graph_id, round(count_if(symbol = 'UNKNOWN') / count(*), 6) AS unknown_share,
      count_if(symbol = 'UNKNOWN') / count(*) > 0.1 AS warn FROM nodes GROUP BY 1""", "tree"))
def _unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = graph.unknown_share(nodes(spark, sf_dir), threshold=0.1)
    return shares.withColumn("unknown_share", F.round("unknown_share", 6))


@query("histogram_cosine", "D28", sql=with_views(
    """h AS (SELECT graph_id, symbol, count(*) AS n FROM nodes GROUP BY 1, 2),
    p AS (SELECT c_custkey AS graph_id, c_custkey // 10 * 10 AS reference_id FROM customer),
    m AS (SELECT p.*, symbol, n FROM p JOIN h USING (graph_id))
    SELECT p.graph_id, p.reference_id, round(coalesce((SELECT sum(m.n * h.n) FROM m JOIN h
        ON m.reference_id = h.graph_id AND m.symbol = h.symbol WHERE m.graph_id = p.graph_id)
      / (sqrt((SELECT sum(n * n) FROM h WHERE h.graph_id = p.graph_id))
       * sqrt((SELECT sum(n * n) FROM h WHERE h.graph_id = p.reference_id))), 0), 6)
      AS similarity FROM p""", "tree"))
def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("graph_id"),
        (F.floor(F.col("c_custkey") / 10) * 10).alias("reference_id"),
    )
    similar = graph.cosine_to_reference(graph.symbol_histogram(nodes(spark, sf_dir)), pairs)
    return similar.withColumn("similarity", F.round("similarity", 6))


_ALL_EDGES = f"{_WALK}, {_SIBLINGS}, {_USES}, all_edges AS (SELECT * FROM child_edges UNION ALL " \
    "SELECT * FROM siblings UNION ALL SELECT * FROM uses)"


def all_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_nodes, edges = stored_tree(spark, sf_dir)
    walked = graph.walk(all_nodes, edges)
    return all_nodes, edges.unionByName(graph.sibling_edges(all_nodes, edges)).unionByName(
        graph.data_dependency_edges(walked)
    )


@query("edge_kind_subsets", "G7", sql=with_views(
    f"""{_ALL_EDGES}, c AS (SELECT * FROM (VALUES {', '.join(
      f"('{name}', '{kind}')" for name, kinds in graph.EDGE_CONFIGS.items() for kind in kinds)})
      t(config, kind)) SELECT config, kind, count(*) AS n FROM all_edges JOIN c USING (kind)
    GROUP BY 1, 2""", "tree"))
def _subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = all_edges(spark, sf_dir)
    return graph.edge_subsets(edges).groupBy("config", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_spans", "W9", sql=with_views(
    f"""ev AS (SELECT * FROM (VALUES {', '.join(
      f"('{s}', '{f}')" for symbols, names in graph.EVIDENCE.items()
      for s in symbols for f in names)}) t(symbol, feature))
    SELECT graph_id, feature, node_id, line, "column" FROM nodes JOIN ev USING (symbol)
    QUALIFY row_number() OVER (PARTITION BY graph_id, feature ORDER BY node_id) <= 5""", "tree"))
def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.evidence_spans(nodes(spark, sf_dir))


_RECORDS = f"""{_WALK}, {_FEATURES}, {_RULE}, rec AS (SELECT graph_id,
    {list(TIME_CLASSES)}[(graph_id % 4 + 1)::INT] AS label,
    CASE WHEN graph_id % 5 = 0 THEN 'O(n log n)' ELSE rule_time END AS answer FROM rule),
  wrong AS (SELECT * FROM rec WHERE label <> answer),
  sym AS (SELECT graph_id, list(DISTINCT symbol) AS s FROM nodes GROUP BY 1),
  hits AS (SELECT graph_id, unnest(list_filter([
      CASE WHEN list_has_any(s, {list(graph.AMORTISED)}) THEN 'amortised_structures' END,
      CASE WHEN list_contains(s, 'RECURSE') AND (list_has_any(s, {list(graph.MEMO)}) OR
        list_has_all(s, ['ARRAY_INDEX', 'ASSIGN'])) THEN 'memoised_recursion' END,
      CASE WHEN list_has_any(s, {list(graph.LIBRARY)}) THEN 'hidden_in_library_call' END,
      CASE WHEN list_contains(s, 'BREAK') OR (list_has_any(s, {list(graph.LOOPS)})
        AND list_has_all(s, ['BRANCH', 'RETURN'])) THEN 'input_dependent_early_exit' END,
      CASE WHEN (label, answer) IN (('O(n)', 'O(n log n)'), ('O(n log n)', 'O(n)'))
        THEN 'on_vs_onlogn_boundary' END], lambda x: x IS NOT NULL)) AS bucket
    FROM wrong JOIN sym USING (graph_id))"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_nodes, edges = stored_tree(spark, sf_dir)
    ruled = graph.rule_prediction(graph.tabular_features(all_nodes, edges))
    return all_nodes, ruled.select(
        "graph_id",
        class_at(F.col("graph_id") % 4, TIME_CLASSES).alias("label"),
        F.when(F.col("graph_id") % 5 == 0, "O(n log n)").otherwise(F.col("rule_time")).alias("answer"),
    )


@query("failure_buckets", "D18", sql=with_views(
    f"""{_RECORDS}, b AS (SELECT unnest(['amortised_structures', 'memoised_recursion',
      'hidden_in_library_call', 'input_dependent_early_exit', 'on_vs_onlogn_boundary']) AS bucket)
    SELECT b.bucket, count(graph_id) AS n, (SELECT count(*) FROM wrong) AS misclassified,
      round(count(graph_id) / (SELECT count(*) FROM wrong), 6) AS share
    FROM b LEFT JOIN hits USING (bucket) GROUP BY 1""", "tree"))
def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, _ = graph.failure_buckets(*_judged(spark, sf_dir), "time")
    return counts.withColumn("share", F.round("share", 6))


@query("failure_bucket_examples", "D18", sql=with_views(
    f"""{_RECORDS} SELECT bucket, graph_id FROM hits
    QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY graph_id) <= 5""", "tree"))
def _bucket_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, examples = graph.failure_buckets(*_judged(spark, sf_dir), "time")
    return examples.select("bucket", "graph_id")


# ---------------------------------------------------------------------------- calls, entries
def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer = table(spark, sf_dir, "customer")
    definitions = customer.select(
        F.col("c_nationkey").alias("graph_id"),
        F.concat(F.lit("f"), F.col("c_custkey") % 97).alias("name"),
        F.col("c_custkey").alias("node_id"),
    )
    key = F.concat(F.lit("f"), F.col("o_orderkey") % 101)
    calls = table(spark, sf_dir, "orders").join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("c_nationkey").alias("graph_id"),
        F.col("o_orderkey").alias("node_id"),
        F.when(F.col("o_orderkey") % 3 == 0, key)
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("self."), key))
        .otherwise(F.concat(F.lit("this->box."), key)).alias("callee"),
    )
    return definitions, calls


@query("call_site_resolution", "J7", "P11", sql="""
  WITH d AS (SELECT c_nationkey AS g, 'f' || (c_custkey % 97) AS name, min(c_custkey) AS node
    FROM customer GROUP BY 1, 2)
  SELECT c_nationkey AS graph_id, o_orderkey AS src, node AS dst, 'CALL_EDGE' AS kind
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN d ON c_nationkey = g AND name = 'f' || (o_orderkey % 101)""")
def _resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_calls(*_calls(spark, sf_dir))


@query("entry_selection", "G10", sql="""
  WITH RECURSIVE fn AS (SELECT DISTINCT c_custkey % 40 AS graph_id, c_custkey // 40 AS node_id
    FROM customer),
  c AS (SELECT DISTINCT c_custkey % 40 AS graph_id, c_custkey // 40 AS src,
    CASE WHEN c_custkey % 40 % 3 = 0 THEN (c_custkey // 40 + c_nationkey) % 5
      ELSE least(c_custkey // 40 + c_nationkey % 3, 36) END AS dst FROM customer),
  calls AS (SELECT c.* FROM c JOIN fn ON c.graph_id = fn.graph_id AND dst = node_id
    WHERE src <> dst),
  roots AS (SELECT * FROM fn WHERE (graph_id, node_id) NOT IN (SELECT graph_id, dst FROM calls)),
  r AS (SELECT * FROM roots UNION SELECT r.graph_id, dst FROM r JOIN calls
    ON r.graph_id = calls.graph_id AND node_id = src),
  rest AS (SELECT * FROM fn WHERE (graph_id, node_id) NOT IN (SELECT * FROM r)),
  inn AS (SELECT calls.* FROM calls JOIN rest a ON calls.graph_id = a.graph_id AND src = a.node_id
    JOIN rest b ON calls.graph_id = b.graph_id AND dst = b.node_id),
  reach AS (SELECT graph_id, src AS a, dst AS b FROM inn UNION SELECT reach.graph_id, a, dst
    FROM reach JOIN inn ON reach.graph_id = inn.graph_id AND b = src),
  groups AS (SELECT rest.graph_id, rest.node_id, least(rest.node_id, min(x.b)) AS grp FROM rest
    LEFT JOIN (SELECT p.graph_id, p.a, p.b FROM reach p JOIN reach q ON p.graph_id = q.graph_id
      AND p.a = q.b AND p.b = q.a) x ON rest.graph_id = x.graph_id AND rest.node_id = x.a
    GROUP BY 1, 2),
  entered AS (SELECT DISTINCT inn.graph_id, d.grp FROM inn
    JOIN groups s ON inn.graph_id = s.graph_id AND src = s.node_id
    JOIN groups d ON inn.graph_id = d.graph_id AND dst = d.node_id WHERE s.grp <> d.grp)
  SELECT graph_id, node_id, 'root' AS kind FROM roots UNION ALL
  SELECT graph_id, node_id, 'cycle' FROM groups WHERE node_id = grp
    AND (graph_id, grp) NOT IN (SELECT graph_id, grp FROM entered)""")
def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # functions are customers in 40 files; a third of the files call around in circles
    customer = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 40).alias("graph_id"),
        F.floor(F.col("c_custkey") / 40).alias("node_id"), "c_nationkey",
    )
    functions = customer.select(
        "graph_id", "node_id", F.concat(F.lit("f"), "node_id").alias("name")
    )
    around = (F.col("node_id") + F.col("c_nationkey")) % 5
    ahead = F.least(F.col("node_id") + F.col("c_nationkey") % 3, F.lit(36))
    calls = customer.select(
        "graph_id", F.col("node_id").alias("src"),
        F.when(F.col("graph_id") % 3 == 0, around).otherwise(ahead).alias("dst"),
    )
    return graph.select_entries(functions, calls, excluded=("main", "Main"))


# ------------------------------------------------------------------------------- messages
SIZE = 8
_KINDS = ("AST_CHILD", "NEXT_SIBLING", "DATA_DEP")


def _matrix(seed: int) -> np.ndarray:
    j, i = np.mgrid[0:SIZE, 0:SIZE]
    return ((j * 7 + i * 3 + seed * 5) % 11 - 5) / 10.0


def _vector(seed: int) -> np.ndarray:
    return ((np.arange(SIZE) + seed) % 3 - 1) / 10.0


def layer_weights(round_number: int) -> message.LayerWeights:
    """Weights by rule: the operator takes whatever weights a model supplies."""
    return message.LayerWeights(
        own=_matrix(round_number),
        own_bias=_vector(round_number),
        by_kind={k: (_matrix(i + 2), _vector(i + 1)) for i, k in enumerate(_KINDS)},
        gamma=1.0 + _vector(0),
        beta=_vector(2),
    )


def node_vectors(spark: SparkSession, sf_dir: str, all_nodes: DataFrame) -> DataFrame:
    """Every symbol starts from the mean of its share of all vectors.

    Component j of a vector counts for dimension j mod SIZE.
    """
    symbol = (F.col("vec_id") % len(graph.SYMBOLS)).alias("symbol_id")
    folded = [
        F.aggregate(
            F.filter("embedding", lambda _, j: j % SIZE == i), F.lit(0.0),
            lambda acc, v: acc + v.cast("double"),
        )
        for i in range(SIZE)
    ]
    embedding = table(spark, sf_dir, "embeddings").groupBy(symbol).agg(
        F.array(*[F.avg(x) * 8 for x in folded]).alias("x")
    )
    encoded = graph.encoded_nodes(all_nodes.select("graph_id").distinct(), all_nodes)
    return message.initial_vectors(encoded, embedding)


def _sql_vector(v: np.ndarray) -> str:
    return "[" + ", ".join(repr(float(x)) for x in v) + "]::DOUBLE[]"


def _sql_product(matrix: np.ndarray, x: str) -> str:
    return "[" + ", ".join(
        "(" + " + ".join(f"{float(w)!r} * {x}[{i + 1}]" for i, w in enumerate(row)) + ")"
        for row in matrix
    ) + "]"


def _sql_round(source: str, target: str, w: message.LayerWeights) -> str:
    """One message round from its definition, every message formed on its own edge."""
    messages = " UNION ALL ".join(
        f"SELECT e.graph_id, e.dst AS node_id, {_sql_product(m, 'v.x')} AS a, {_sql_vector(b)} AS c"
        f" FROM all_edges e JOIN {source} v ON e.graph_id = v.graph_id AND e.src = v.node_id"
        f" WHERE e.kind = '{k}'"
        for k, (m, b) in w.by_kind.items()
    )
    sums = ", ".join(f"sum(a[{i + 1}] + c[{i + 1}])" for i in range(SIZE))
    return f"""{target}_in AS (SELECT graph_id, node_id, [{sums}] AS s FROM ({messages})
      GROUP BY 1, 2),
    {target}_out AS (SELECT v.graph_id, v.node_id, list_transform(range(1, {SIZE + 1}),
        lambda i: ({_sql_product(w.own, 'v.x')})[i] + ({_sql_vector(w.own_bias)})[i]
          + coalesce(s[i], 0)) AS o
      FROM {source} v LEFT JOIN {target}_in m ON v.graph_id = m.graph_id
        AND v.node_id = m.node_id),
    {target} AS (SELECT graph_id, node_id, list_transform(range(1, {SIZE + 1}), lambda i:
        greatest(0.0, (o[i] - list_avg(o)) / sqrt(list_avg(list_transform(o, lambda y:
          (y - list_avg(o)) * (y - list_avg(o)))) + 1e-5) * ({_sql_vector(w.gamma)})[i]
          + ({_sql_vector(w.beta)})[i])) AS x FROM {target}_out)"""


_FOLDED = ", ".join(
    f"avg(list_sum([embedding[j + 1]::DOUBLE FOR j IN range(len(embedding)) IF j % {SIZE} = {i}])) * 8"
    for i in range(SIZE)
)
_V0 = f"""emb AS (SELECT vec_id % {len(graph.SYMBOLS)} AS sym, [{_FOLDED}] AS x FROM embeddings GROUP BY 1),
    v0 AS (SELECT n.graph_id, n.node_id, x FROM nodes n JOIN emb
    ON sym = list_position({list(graph.SYMBOLS)}, symbol) - 1)"""
_ROUNDS = f"{_ALL_EDGES}, {_V0}, {_sql_round('v0', 'v1', layer_weights(0))}, " \
    f"{_sql_round('v1', 'v2', layer_weights(1))}"
_PICKED = ", ".join(f"round(x[{i + 1}], 5) AS x{i}" for i in range(SIZE))


@query("message_round", "G8", sql=with_views(
    f"{_ROUNDS} SELECT graph_id, node_id, {_PICKED} FROM v1", "tree"))
def _message_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes, edges = all_edges(spark, sf_dir)
    after = message.message_round(
        node_vectors(spark, sf_dir, all_nodes), edges, layer_weights(0)
    )
    return after.select(
        "graph_id", "node_id",
        *[F.round(F.get("x", F.lit(i)), 5).alias(f"x{i}") for i in range(SIZE)],
    )


_HEAD = ((np.arange(3 * 2 * SIZE).reshape(3, 2 * SIZE) * 5) % 7 - 3) / 7.0
_HEAD_BIAS = np.array([0.1, 0.0, -0.1])


def _head_sql(cells: list[str], head: np.ndarray, bias: np.ndarray, digits: int) -> str:
    return ", ".join(
        f"round({' + '.join(f'{float(w)!r} * {c}' for w, c in zip(row, cells, strict=True))}"
        f" + {float(b)!r}, {digits}) AS score_{k}"
        for k, (row, b) in enumerate(zip(head, bias, strict=True))
    )


_CELLS = [f"avg(x[{i + 1}])" for i in range(SIZE)] + [f"max(x[{i + 1}])" for i in range(SIZE)]


@query("graph_forward", "G8", "G9", sql=with_views(
    f"{_ROUNDS} SELECT graph_id, {_head_sql(_CELLS, _HEAD, _HEAD_BIAS, 5)} FROM v2 GROUP BY 1",
    "tree"))
def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes, edges = all_edges(spark, sf_dir)
    edges = written(edges, "edges")
    vectors = message.message_passing(
        node_vectors(spark, sf_dir, all_nodes), edges, [layer_weights(0), layer_weights(1)]
    )
    pooled = message.readout(vectors, SIZE, "meanmax")
    scored = pooled.withColumn("s", message.linear_head(F.col("pooled"), _HEAD, _HEAD_BIAS))
    return scored.select(
        "graph_id", *[F.round(F.get("s", F.lit(k)), 5).alias(f"score_{k}") for k in range(3)]
    )


_MEANS = [f"avg(embedding[{i + 1}]::DOUBLE)" for i in range(64)]
_WIDE = ((np.arange(2 * 64).reshape(2, 64) * 3) % 5 - 2) / 5.0


@query("graph_readout", "G9", sql=f"""
  SELECT label AS graph_id, {_head_sql(_MEANS, _WIDE, _HEAD_BIAS[:2], 6)}
  FROM embeddings GROUP BY 1""")
def _readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("graph_id"), F.col("embedding").cast("array<double>").alias("x")
    )
    pooled = message.readout(vectors, 64)
    scored = pooled.withColumn("s", message.linear_head(F.col("pooled"), _WIDE, _HEAD_BIAS[:2]))
    return scored.select(
        "graph_id", *[F.round(F.get("s", F.lit(k)), 6).alias(f"score_{k}") for k in range(2)]
    )
