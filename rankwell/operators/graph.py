"""Program graphs as node and edge tables.

Nodes: (graph_id, node_id, symbol, line, column, text); node ids grow in document
order.  Edges: (graph_id, src, dst, kind).  A graph may be of any size; nothing
here gathers one graph in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rankwell.functions.ordinal import class_array, literal_map
from rankwell.functions.skew import keep_lowest, next_in_group, running_total
from rankwell.functions.stats import share
from rankwell.session import discard, written, written_bucketed, written_counted

# The symbol alphabet in its order, edge kinds, and symbol groups.
SYMBOLS = (
    "FUNC_DEF", "PARAM", "RETURN", "BLOCK", "CALL", "RECURSE",
    "LOOP_CONST_BOUND", "LOOP_N_BOUND", "LOOP_HALVING", "BRANCH", "BREAK", "CONTINUE",
    "ARRAY_ALLOC", "ARRAY_INDEX", "HASH_ALLOC", "HASH_LOOKUP", "HASH_INSERT", "SET_OP",
    "LIST_APPEND", "STRING_CONCAT", "SLICE", "COPY",
    "SORT", "BINARY_SEARCH", "HEAP_PUSH", "HEAP_POP", "QUEUE_OP",
    "MATH_OP_CONST", "MATH_OP_LINEAR", "MATH_OP_LOG",
    "ALLOC_CONST", "ALLOC_N", "ALLOC_NESTED",
    "ASSIGN", "ARITH", "COMPARE", "LITERAL", "IDENT", "UNKNOWN",
)
EDGE_KINDS = ("AST_CHILD", "NEXT_SIBLING", "DATA_DEP", "LOOP_CARRY", "CALL_EDGE")
EDGE_CONFIGS = {
    "structural_only": ("AST_CHILD", "NEXT_SIBLING"),
    "structural_plus_data_dep": ("AST_CHILD", "NEXT_SIBLING", "DATA_DEP"),
    "structural_plus_loop_carry": ("AST_CHILD", "NEXT_SIBLING", "LOOP_CARRY"),
    "structural_plus_call_edge": ("AST_CHILD", "NEXT_SIBLING", "CALL_EDGE"),
    "all_edges": EDGE_KINDS,
}
LOOPS = ("LOOP_CONST_BOUND", "LOOP_N_BOUND", "LOOP_HALVING")
ALLOCS = ("ARRAY_ALLOC", "HASH_ALLOC")
LIBRARY_FEATURES = {
    "sort_call_count": ("SORT",),
    "binary_search_call_count": ("BINARY_SEARCH",),
    "heap_op_count": ("HEAP_PUSH", "HEAP_POP"),
    "math_op_count": ("MATH_OP_CONST", "MATH_OP_LINEAR", "MATH_OP_LOG"),
}
FEATURES = (
    "max_loop_nesting_depth", "max_alloc_nesting_depth", "loop_count", "alloc_count",
    "alloc_inside_loop_count", "recursion_call_count", "branch_count", "break_count",
    "continue_count", "sort_call_count", "binary_search_call_count", "heap_op_count",
    "math_op_count", "call_count", "node_count", "edge_count",
    "loop_count_depth_0", "loop_count_depth_1", "loop_count_depth_2", "loop_count_depth_3",
    "recursion_shape_none", "recursion_shape_single", "recursion_shape_multiple",
)
FEATURE_FAMILIES = {
    "loop": (
        "max_loop_nesting_depth", "loop_count", "loop_count_depth_0", "loop_count_depth_1",
        "loop_count_depth_2", "loop_count_depth_3",
    ),
    "allocation": ("max_alloc_nesting_depth", "alloc_count", "alloc_inside_loop_count"),
    "recursion": (
        "recursion_call_count", "recursion_shape_none", "recursion_shape_single",
        "recursion_shape_multiple",
    ),
    "control_flow": ("branch_count", "break_count", "continue_count"),
    "library_calls": (
        "sort_call_count", "binary_search_call_count", "heap_op_count", "math_op_count",
        "call_count",
    ),
    "graph_size": ("node_count", "edge_count"),
}
#: Which symbols give evidence for which features.
EVIDENCE = {
    LOOPS: FEATURE_FAMILIES["loop"],
    ALLOCS: FEATURE_FAMILIES["allocation"],
    ("RECURSE",): FEATURE_FAMILIES["recursion"],
    ("BRANCH",): ("branch_count",),
    ("BREAK",): ("break_count",),
    ("CONTINUE",): ("continue_count",),
    ("CALL",): ("call_count",),
    **{symbols: (name,) for name, symbols in LIBRARY_FEATURES.items()},
}
#: Symbol groups behind the failure buckets.
MEMO = ("HASH_LOOKUP", "HASH_INSERT")
AMORTISED = ("LIST_APPEND", "SET_OP", "HASH_INSERT")
LIBRARY = (
    "SORT", "BINARY_SEARCH", "HEAP_PUSH", "HEAP_POP", "QUEUE_OP",
    "MATH_OP_CONST", "MATH_OP_LINEAR", "MATH_OP_LOG",
)
TIME_BY_LOOP_DEPTH = ("O(1)", "O(n)", "O(n^2)", "O(n^3)")
SPACE_BY_ALLOC_DEPTH = ("O(1)", "O(n)", "O(n^2)")
UNKNOWN_SHARE = 0.2
# Functions that drive a solution, and those that are the program if they read input.
NON_ENTRIES = ("main", "Main", "__init__", "__main__", "setUp", "tearDown")
PROGRAMS = ("main", "Main")

NODE = ["graph_id", "node_id"]
#: Width of the id ranges a hot group is cut into.
BLOCK_BITS = 20


def id_block(column: str, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(F.col(column), bits)


# ---------------------------------------------------------------- walking the tree
def children(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind") == "AST_CHILD").select("graph_id", "src", "dst")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are nobody's child."""
    with_parent = children(edges).select("graph_id", F.col("dst").alias("node_id"))
    return nodes.join(with_parent, NODE, "left_anti")


def _above(column: str) -> Column:
    return F.col(f"above {column}")


def _jumped(first: DataFrame, extend: Callable[[], list[Column]], name: str) -> DataFrame:
    """Pointer jumping over rows (graph_id, node_id, up, ...) until none points on.

    A row describes the stretch from its node to ``up``; ``extend`` gives its columns over
    the stretch of ``up`` as well, whose columns are named ``above ...``.  Stretches double,
    so rounds grow with the logarithm of the depth, and a round writes the rows still
    pointing on only.  Rows that point to a missing node are left out.
    """
    open_rows = F.col("up").isNotNull()
    table, left = written_counted(first, name, open_rows)
    tables = [table]
    # n nodes that point on make no chain of more than n steps
    rounds = left.bit_length() + 1
    while left:
        if rounds == 0:
            raise ValueError("a node is reached twice: the child edges hold a cycle")
        rounds -= 1
        now = tables[-1].filter(open_rows)
        lookup = now
        for earlier in tables:
            lookup = lookup.unionByName(earlier.filter(~open_rows))
        lookup = lookup.select(*[F.col(c).alias(f"above {c}") for c in lookup.columns])
        step = now.join(
            lookup, (F.col("graph_id") == _above("graph_id")) & (F.col("up") == _above("node_id"))
        ).select("graph_id", "node_id", _above("up").alias("up"), *extend())
        table, left = written_counted(step, name, open_rows)
        tables.append(table)
    if len(tables) == 1:
        return tables[0].drop("up")
    ended = tables[0].filter(~open_rows)
    for table in tables[1:]:
        ended = ended.unionByName(table.filter(~open_rows))
    kept = written(ended.drop("up"), name)
    for table in tables:
        discard(table)
    return kept


def ancestry(nodes: DataFrame, edges: DataFrame, marks: Mapping[str, Column]) -> DataFrame:
    """(graph_id, node_id, level, n_<mark>, <mark>) of every node below a root, and roots.

    ``marks`` are tests on a node.  ``n_<mark>`` counts the marked nodes strictly above,
    ``<mark>`` is the nearest of them: its id and how many levels up it stands.  A node
    with two parents, or on a cycle, is an error; nodes that no root reaches for want of
    a parent in ``nodes`` are left out.
    """
    conflict = Observation()
    parent = (
        children(edges).groupBy("graph_id", F.col("dst").alias("node_id"))
        .agg(F.min("src").alias("up"), F.max("src").alias("last"))
        .observe(conflict, F.count_if(F.col("up") != F.col("last")).alias("n"))
    ).drop("last")
    tested = nodes.select(
        "graph_id", F.col("node_id").alias("up"), *[test.alias(f"is {m}") for m, test in marks.items()],
        F.lit(True).alias("known"),
    )
    placed = nodes.select(*NODE).join(parent, NODE, "left").join(tested, ["graph_id", "up"], "left")
    one_up = F.struct(F.col("up").alias("id"), F.lit(1).alias("steps"))
    first = placed.filter(F.col("up").isNull() | F.col("known")).select(
        *NODE, "up", F.col("up").isNotNull().cast("int").alias("level"),
        *[c for m in marks for c in (
            F.coalesce(F.col(f"is {m}"), F.lit(False)).cast("int").alias(f"n_{m}"),
            F.when(F.col(f"is {m}"), one_up).alias(m),
        )],
    )

    def extend() -> list[Column]:
        def nearest(mark: str) -> Column:
            above = _above(mark)
            moved = F.struct(above["id"].alias("id"), (above["steps"] + F.col("level")).alias("steps"))
            return F.coalesce(F.col(mark), F.when(above.isNotNull(), moved)).alias(mark)

        sums = [f"n_{m}" for m in marks]
        return [
            (F.col("level") + _above("level")).alias("level"),
            *[c for m, n in zip(marks, sums, strict=True) for c in ((F.col(n) + _above(n)).alias(n), nearest(m))],
        ]

    found = _jumped(first, extend, "stretch")
    if conflict.get["n"]:
        raise ValueError("a node is reached twice: it has two parents")
    return found


def _chains(marked: DataFrame, stop: bool) -> DataFrame:
    """(graph_id, node_id, chain): the marked nodes above a marked node, nearest first.

    ``marked`` has ``root``, the nearest of them; with ``stop``, chains end at the nearest
    stop, which may be in them.
    """

    def within(chain: Column) -> Column:
        limit = F.col("stop")["steps"]
        return F.when(limit.isNull(), chain).otherwise(F.filter(chain, lambda r: r["steps"] <= limit)) if stop else chain

    none = F.array().cast("array<struct<id:bigint,steps:int>>")
    own = F.when(F.col("root").isNull(), none).otherwise(F.array("root"))
    extra = ["stop"] if stop else []
    first = marked.select(*NODE, F.col("root")["id"].alias("up"), *extra, within(own).alias("chain"),
                          F.coalesce(F.col("root")["steps"], F.lit(0)).alias("steps"))
    if stop:
        # nothing above the stop can be in the chain
        first = first.withColumn("up", F.when(F.size("chain") > 0, F.col("up")))

    def extend() -> list[Column]:
        moved = F.transform(_above("chain"), lambda r: F.struct(
            r["id"].alias("id"), (r["steps"] + F.col("steps")).alias("steps")))
        return [*map(F.col, extra), within(F.concat("chain", moved)).alias("chain"),
                (F.col("steps") + _above("steps")).alias("steps")]

    return _jumped(first, extend, "chain").drop("steps", "stop")


def _pairs_above(below: DataFrame, marked: DataFrame, stop: bool = False) -> DataFrame:
    """Rows of ``below`` with ``root_id`` and ``depth`` for each marked node above them."""
    chains = _chains(marked, stop).select(
        F.col("graph_id").alias("chain_graph"), F.col("node_id").alias("chain_node"), "chain"
    )
    joined = below.filter(F.col("root").isNotNull()).join(
        chains, (F.col("graph_id") == F.col("chain_graph")) & (F.col("root")["id"] == F.col("chain_node"))
    ).drop("chain_graph", "chain_node")
    moved = F.transform("chain", lambda r: F.struct(
        r["id"].alias("id"), (r["steps"] + F.col("root")["steps"]).alias("steps")))
    every = F.concat(F.array("root"), moved)
    if stop:
        limit = F.col("stop")["steps"]
        every = F.when(limit.isNull(), every).otherwise(F.filter(every, lambda r: r["steps"] <= limit))
    pairs = joined.withColumn("pair", F.explode(every)).drop("chain")
    return pairs.withColumns({"root_id": F.col("pair")["id"], "depth": F.col("pair")["steps"]}).drop("pair")


def walk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node below a root with its level, loops above it and nearest function."""
    marks = {"loop": F.col("symbol").isin(*LOOPS), "scope": F.col("symbol") == "FUNC_DEF"}
    found = ancestry(nodes, edges, marks).select(
        *NODE, "level", F.col("n_loop").alias("loop_depth"), F.col("scope")["id"].alias("scope")
    )
    return nodes.select(*NODE, "symbol", "text").join(found, NODE)


def descendants(
    nodes: DataFrame, edges: DataFrame, of: DataFrame, stop_symbol: str | None = None
) -> DataFrame:
    """(graph_id, root, node_id, symbol, text, depth) below every node of ``of``.

    A node with ``stop_symbol`` is included but not entered.
    """
    stop = stop_symbol is not None
    flagged = nodes.select(*NODE, "symbol").join(
        of.select(*NODE, F.lit(True).alias("chosen")).distinct(), NODE, "left"
    )
    marks = {"root": F.col("chosen")} | ({"stop": F.col("symbol") == stop_symbol} if stop else {})
    found = ancestry(flagged, edges, marks)
    marked = found.join(of.select(*NODE).distinct(), NODE, "left_semi")
    pairs = _pairs_above(found, marked, stop).select("graph_id", "node_id", "root_id", "depth")
    return pairs.join(nodes.select(*NODE, "symbol", "text"), NODE).select(
        "graph_id", F.col("root_id").alias("root"), "node_id", "symbol", "text", "depth"
    )


def loop_carry_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Loop -> every identifier that occurs at least twice anywhere below it.

    Only identifiers whose name repeats below some loop meet the loops above them.
    """
    loops = F.col("symbol").isin(*LOOPS)
    found = ancestry(nodes, edges, {"root": loops})
    named = nodes.filter((F.col("symbol") == "IDENT") & F.col("text").isNotNull()).select(*NODE, "text")
    idents = named.join(found.filter(F.col("root").isNotNull()).select(*NODE, "root"), NODE)
    # two different ids are enough to know a name repeats
    first_and_last = (F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    names = idents.groupBy("graph_id", "text").agg(*first_and_last).filter("a < b").select("graph_id", "text")
    marked = found.join(nodes.filter(loops).select(*NODE), NODE, "left_semi")
    pairs = written(
        _pairs_above(idents.join(names, ["graph_id", "text"], "left_semi"), marked).select(
            "graph_id", F.col("root_id").alias("src"), "text", F.col("node_id")
        ),
        "loop_pairs",
    )
    key = ["graph_id", "src", "text"]
    repeated = pairs.groupBy(*key).agg(*first_and_last).filter("a < b").select(*key)
    return pairs.join(repeated, key, "left_semi").select(
        "graph_id", "src", F.col("node_id").alias("dst"), F.lit("LOOP_CARRY").alias("kind")
    )


def data_dependency_edges(walked: DataFrame) -> DataFrame:
    """Consecutive identifiers of one name in one function, in document order."""
    idents = walked.filter((F.col("symbol") == "IDENT") & F.col("scope").isNotNull()).select(
        "graph_id", "scope", "text", "node_id"
    )
    chained = next_in_group(
        idents, ["graph_id", "scope", "text"], "node_id", id_block("node_id")
    )
    return chained.filter(F.col("next").isNotNull()).select(
        "graph_id", F.col("node_id").alias("src"), F.col("next").alias("dst"),
        F.lit("DATA_DEP").alias("kind"),
    )


def sibling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node to the next child of the same parent; nodes without one are siblings too.

    Node ids are not negative, so -1 stands for the missing parent.
    """
    placed = children(edges).unionByName(
        roots(nodes, edges).select(
            "graph_id", F.lit(-1).cast("bigint").alias("src"), F.col("node_id").alias("dst")
        )
    )
    chained = next_in_group(placed, ["graph_id", "src"], "dst", id_block("dst"))
    return chained.filter(F.col("next").isNotNull()).select(
        "graph_id", F.col("dst").alias("src"), F.col("next").alias("dst"),
        F.lit("NEXT_SIBLING").alias("kind"),
    )


# -------------------------------------------------------------------- features
def tabular_features(nodes: DataFrame, edges: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """Counts and depths per graph: one grouping over the walk, the nodes and the edges."""
    walked = walk(nodes, edges) if walked is None else walked
    symbol = F.col("symbol")
    rows = (
        walked.select("graph_id", "symbol", "loop_depth", F.lit(0).alias("nodes"), F.lit(0).alias("edges"))
        .unionByName(nodes.select("graph_id", F.lit(1).alias("nodes")), allowMissingColumns=True)
        .unionByName(edges.select("graph_id", F.lit(1).alias("edges")), allowMissingColumns=True)
    )
    loop, alloc = symbol.isin(*LOOPS), symbol.isin(*ALLOCS)
    count = lambda test: F.count_if(test).cast("int")
    deepest = lambda test, value: F.coalesce(F.max(F.when(test, value)), F.lit(0))
    counted = rows.groupBy("graph_id").agg(
        deepest(loop, F.col("loop_depth") + 1).alias("max_loop_nesting_depth"),
        deepest(alloc, F.col("loop_depth")).alias("max_alloc_nesting_depth"),
        count(loop).alias("loop_count"),
        count(alloc).alias("alloc_count"),
        count(alloc & (F.col("loop_depth") > 0)).alias("alloc_inside_loop_count"),
        count(symbol == "RECURSE").alias("recursion_call_count"),
        count(symbol == "BRANCH").alias("branch_count"),
        count(symbol == "BREAK").alias("break_count"),
        count(symbol == "CONTINUE").alias("continue_count"),
        *[count(symbol.isin(*s)).alias(name) for name, s in LIBRARY_FEATURES.items()],
        count(symbol == "CALL").alias("call_count"),
        F.coalesce(F.sum("nodes"), F.lit(0)).cast("int").alias("node_count"),
        F.coalesce(F.sum("edges"), F.lit(0)).cast("int").alias("edge_count"),
        *[
            count(loop & (F.least(F.col("loop_depth"), F.lit(3)) == d)).alias(f"loop_count_depth_{d}")
            for d in range(4)
        ],
    )
    return with_recursion_shape(counted)


def with_recursion_shape(features: DataFrame) -> DataFrame:
    """Add ``recursion_shape`` and its three 0/1 columns."""
    calls = F.col("recursion_call_count")
    shape = F.when(calls == 0, "none").when(calls == 1, "single").otherwise("multiple")
    named = features.withColumn("recursion_shape", shape)
    return named.withColumns(
        {
            f"recursion_shape_{s}": (F.col("recursion_shape") == s).cast("int")
            for s in ("none", "single", "multiple")
        }
    )


def rule_prediction(features: DataFrame) -> DataFrame:
    """Time by loop depth and space by allocation depth, both clamped."""

    def by_depth(column: str, classes: Sequence[str]) -> Column:
        depth = F.least(F.col(column), F.lit(len(classes) - 1)).cast("int")
        return F.element_at(class_array(classes), depth + 1)

    return features.withColumns(
        {
            "rule_time": by_depth("max_loop_nesting_depth", TIME_BY_LOOP_DEPTH),
            "rule_space": by_depth("max_alloc_nesting_depth", SPACE_BY_ALLOC_DEPTH),
        }
    )


# ------------------------------------------------------- encoding and re-indexing
def encoded_nodes(graphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with symbol numbers; a graph without nodes gets one UNKNOWN node.

    ``graphs`` lists every graph id.  Edges need no change: they are a table with
    a kind column already.
    """
    index = {s: i for i, s in enumerate(SYMBOLS)}
    number = F.element_at(literal_map(index), F.coalesce("symbol", F.lit("UNKNOWN")))
    return graphs.select("graph_id").join(nodes, "graph_id", "left").select(
        "graph_id", F.coalesce("node_id", F.lit(0)).alias("node_id"), number.alias("symbol_id")
    )


def local_index(nodes: DataFrame, coarse_bits: int = 46) -> DataFrame:
    """Add ``position``: 0, 1, 2, ... in document order within each graph."""
    return running_total(
        nodes, ["graph_id"], [id_block("node_id", coarse_bits), id_block("node_id")],
        [F.col("node_id")], F.lit(1), name="position",
    ).withColumn("position", F.col("position") - 1)


def global_index(nodes: DataFrame, coarse_bits: int = 46) -> DataFrame:
    """Add ``global_id``: all graphs on one dense node axis, in graph and document order."""
    placed = local_index(nodes, coarse_bits)
    sizes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size"))
    ends = running_total(
        sizes, [], [id_block("graph_id"), id_block("graph_id", 10)],
        [F.col("graph_id")], F.col("size"), name="upto",
    )
    offsets = ends.select("graph_id", (F.col("upto") - F.col("size")).alias("offset"))
    return placed.join(offsets, "graph_id").withColumn(
        "global_id", F.col("offset") + F.col("position")
    )


def reindexed_edges(edges: DataFrame, indexed: DataFrame, index: str) -> DataFrame:
    """Edges whose ends are replaced by ``index`` of the node table.

    The index is stored once in buckets by node, so both lookups shuffle the edges only.
    """
    spark = edges.sparkSession
    places, table = written_bucketed(
        indexed.select(*NODE, F.col(index).alias("place")), "places", *NODE
    )

    def end(name: str) -> DataFrame:
        return places.select(
            "graph_id", F.col("node_id").alias(name), F.col("place").alias(f"_{name}")
        )

    placed = written(
        edges.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"])
        .select("graph_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "kind"),
        "edges",
    )
    discard(places)
    spark.sql(f"DROP TABLE {table}")
    return placed


def structure_signature(nodes: DataFrame, edges: DataFrame, position: str = "position") -> DataFrame:
    """A hash of symbols in order and of all edges, names and literals left out.

    Every node and edge is hashed with its place; the hashes are added up in four
    60-bit lanes, and the sums are hashed.  Addition needs no order, so a graph
    of any size is combined on the map side.  Edges must use the same positions.
    """
    rows = nodes.select(
        "graph_id", F.concat_ws("|", F.lit("n"), F.col(position), "symbol").alias("item")
    ).unionByName(
        edges.select("graph_id", F.concat_ws("|", F.lit("e"), "kind", "src", "dst").alias("item"))
    ).withColumn("hash", F.sha2("item", 256))
    lane = lambda i: F.conv(F.substring("hash", 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")
    sums = rows.groupBy("graph_id").agg(*[F.sum(lane(i)).alias(f"l{i}") for i in range(4)])
    return sums.select(
        "graph_id",
        F.sha2(F.concat_ws("|", *[F.col(f"l{i}").cast("string") for i in range(4)]), 256).alias(
            "signature"
        ),
    )


#: Symbols of one text at most, and of one task of :func:`symbol_grams`.
TEXT_SYMBOLS = 1 << 20


def symbol_text(indexed: DataFrame, piece: int = TEXT_SYMBOLS) -> DataFrame:
    """The symbols of each graph in document order as one text.

    Only graphs of more than ``piece`` symbols have several, numbered ones.
    """
    symbols = F.array_sort(F.collect_list(F.struct("position", "symbol")))
    return indexed.groupBy(
        "graph_id", F.floor(F.col("position") / piece).alias("piece")
    ).agg(F.array_join(F.transform(symbols, lambda s: s["symbol"]), " ").alias("text"))


def symbol_grams(indexed: DataFrame, piece: int = TEXT_SYMBOLS) -> DataFrame:
    """(graph_id, gram, n): single symbols, pairs and triples of whole graphs.

    A graph is cut into pieces, and each takes the first two symbols of the next one
    along, so no n-gram is lost at a cut.
    """
    if piece < 2:
        raise ValueError("a piece holds two symbols or more")
    cut = indexed.select(
        "graph_id", "position", "symbol", F.floor(F.col("position") / piece).alias("piece")
    )
    at = F.col("position") % piece
    heads = cut.filter(at < 2).groupBy("graph_id", (F.col("piece") - 1).alias("piece")).agg(
        F.max(F.when(at == 0, F.col("symbol"))).alias("first"), F.max(F.when(at == 1, F.col("symbol"))).alias("second")
    )
    inside = Window.partitionBy("graph_id", "piece").orderBy("position")
    led = cut.withColumns({"one": F.lead("symbol", 1).over(inside), "two": F.lead("symbol", 2).over(inside)})
    joined = led.join(heads, ["graph_id", "piece"], "left")
    one = F.coalesce("one", "first")
    two = F.coalesce(F.col("two"), F.when(F.col("one").isNull(), F.col("second")).otherwise(F.col("first")))
    grams = F.array(F.col("symbol"), F.concat_ws(" ", "symbol", one), F.concat_ws(" ", "symbol", one, two))
    n = F.when(two.isNotNull() & one.isNotNull(), 3).when(one.isNotNull(), 2).otherwise(1)
    return joined.select("graph_id", F.explode(F.slice(grams, 1, n)).alias("gram")).groupBy("graph_id", "gram").agg(
        F.count(F.lit(1)).alias("n")
    )


# ------------------------------------------------------------------ summaries
def symbol_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and the symbol histogram as a map of at most 39 entries."""
    counted = nodes.select("graph_id", "symbol", F.lit(0).alias("edge")).unionByName(
        edges.select("graph_id", F.lit(None).cast("string").alias("symbol"), F.lit(1).alias("edge"))
    ).groupBy("graph_id", "symbol").agg(
        F.count_if(F.col("edge") == 0).alias("n"), F.sum("edge").alias("e")
    )
    entry = F.when(F.col("symbol").isNotNull(), F.struct("symbol", "n"))
    return counted.groupBy("graph_id").agg(
        F.sum("n").alias("nodes"),
        F.sum("e").alias("edges"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("histogram"),
    )


def unknown_share(nodes: DataFrame, threshold: float = UNKNOWN_SHARE) -> DataFrame:
    """Share of UNKNOWN nodes per graph and whether it deserves a warning."""
    unknown = F.count_if(F.col("symbol") == "UNKNOWN")
    return nodes.groupBy("graph_id").agg(
        share(unknown, F.count(F.lit(1))).alias("unknown_share"),
    ).withColumn("warn", F.col("unknown_share") > threshold)


def cosine_to_reference(histogram: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of each graph's histogram with the one named for it in ``pairs``.

    ``pairs`` is (graph_id, reference_id), one reference per graph; 0 when either
    side is empty.
    """
    norms = histogram.groupBy("graph_id").agg(
        F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("norm")
    )
    mine = pairs.join(histogram, "graph_id").select(
        "graph_id", "reference_id", "symbol", F.col("n").alias("a")
    )
    other = histogram.select(
        F.col("graph_id").alias("reference_id"), "symbol", F.col("n").alias("b")
    )
    dots = mine.join(other, ["reference_id", "symbol"]).groupBy("graph_id").agg(
        F.sum(F.col("a").cast("double") * F.col("b")).alias("dot")
    )
    reference_norm = norms.select(
        F.col("graph_id").alias("reference_id"), F.col("norm").alias("reference_norm")
    )
    cosine = F.col("dot") / (F.col("norm") * F.col("reference_norm"))
    return (
        pairs.join(norms, "graph_id", "left")
        .join(reference_norm, "reference_id", "left")
        .join(dots, "graph_id", "left")
        .select("graph_id", "reference_id", F.coalesce(cosine, F.lit(0.0)).alias("similarity"))
    )


def edge_subsets(edges: DataFrame, configs: Mapping[str, Sequence[str]] = EDGE_CONFIGS) -> DataFrame:
    """Every edge under each configuration that keeps its kind."""
    table = edges.sparkSession.createDataFrame(
        [(name, kind) for name, kinds in configs.items() for kind in kinds],
        "config string, kind string",
    )
    return edges.join(F.broadcast(table), "kind")


def evidence_spans(nodes: DataFrame, most: int = 5) -> DataFrame:
    """First spans of every feature in document order, at most ``most`` per graph.

    Features with the same symbols share their evidence, so it is ranked once
    per symbol group and only then handed to the features.
    """
    group_of = {s: str(i) for i, symbols in enumerate(EVIDENCE) for s in symbols}
    features = {str(i): list(names) for i, names in enumerate(EVIDENCE.values())}
    grouped = nodes.withColumn("evidence", F.element_at(literal_map(group_of), F.col("symbol")))
    first = keep_lowest(
        grouped.filter(F.col("evidence").isNotNull()), ["graph_id", "evidence"],
        [F.col("node_id")], most,
    )
    names = F.create_map(
        *[x for g, n in features.items() for x in (F.lit(g), F.array(*map(F.lit, n)))]
    )
    return first.select(
        "graph_id", F.explode(F.element_at(names, F.col("evidence"))).alias("feature"),
        "node_id", "line", "column",
    )


def failure_buckets(
    nodes: DataFrame, records: DataFrame, dimension: str, most: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Counts and shares of five overlapping failure patterns, and a few examples of each.

    ``records`` is (graph_id, label, answer); only misclassified ones count.
    Symbol sets are kept as flags, which combine on the map side.
    """
    has = lambda *s: F.bool_or(F.col("symbol").isin(*s))
    flags = nodes.groupBy("graph_id").agg(
        has("RECURSE").alias("recurses"), has(*MEMO).alias("memo"),
        has("ARRAY_INDEX").alias("indexes"), has("ASSIGN").alias("assigns"),
        has(*LIBRARY).alias("library"), has("BREAK").alias("breaks"),
        has(*LOOPS).alias("loops"), has("BRANCH").alias("branches"),
        has("RETURN").alias("returns"), has(*AMORTISED).alias("amortised"),
    )
    wrong = records.filter(~F.col("label").eqNullSafe(F.col("answer")))
    boundary = F.array_sort(F.array("label", "answer")) == F.array(F.lit("O(n log n)"), F.lit("O(n)"))
    tests = {
        "amortised_structures": F.col("amortised"),
        "memoised_recursion": F.col("recurses")
        & (F.col("memo") | (F.col("indexes") & F.col("assigns"))),
        "hidden_in_library_call": F.col("library"),
        "input_dependent_early_exit": F.col("breaks")
        | (F.col("loops") & F.col("branches") & F.col("returns")),
        "on_vs_onlogn_boundary": F.lit(dimension == "time") & boundary,
    }
    named = [F.when(test, F.lit(name)) for name, test in tests.items()]
    matched = wrong.join(flags, "graph_id", "left").select(
        "graph_id", F.array_compact(F.array(*named)).alias("buckets")
    )
    rows = matched.select("graph_id", F.explode("buckets").alias("bucket"))
    total = wrong.agg(F.count(F.lit(1))).scalar()
    grid = nodes.sparkSession.createDataFrame([(b,) for b in tests], "bucket string")
    counts = grid.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "left")
    counts = counts.select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), total.alias("misclassified")
    ).withColumn("share", share(F.col("n"), F.col("misclassified")))
    examples = keep_lowest(rows, ["bucket"], [F.col("graph_id")], most)
    return counts, examples


# ---------------------------------------------------------------- calls, entries
def resolve_calls(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """Call -> definition of the same file by full name, else by the trailing segment.

    ``definitions`` is (graph_id, name, node_id), the lowest id winning on a
    duplicate name; ``calls`` is (graph_id, node_id, callee).
    """
    from rankwell.functions.text import trailing_segment

    first = definitions.groupBy("graph_id", "name").agg(F.min("node_id").alias("target"))
    full = first.select("graph_id", F.col("name").alias("callee"), F.col("target").alias("by_name"))
    tail = first.select("graph_id", F.col("name").alias("tail"), F.col("target").alias("by_tail"))
    return (
        calls.withColumn("tail", trailing_segment(F.col("callee")))
        .join(full, ["graph_id", "callee"], "left")
        .join(tail, ["graph_id", "tail"], "left")
        .withColumn("dst", F.coalesce("by_name", "by_tail"))
        .filter(F.col("dst").isNotNull())
        .select("graph_id", F.col("node_id").alias("src"), "dst", F.lit("CALL_EDGE").alias("kind"))
    )


#: Rounds after which changed labels are merged into one table.
MERGE_ROUNDS = 6


class _Labels:
    """The best label of every node, as a table and the changes written since.

    Labels are structs ending in ``id``, a node of the same graph that reaches this one.
    """

    def __init__(self, start: DataFrame) -> None:
        self.tables = [written(start.select(*NODE, "label"), "labels")]

    def rows(self) -> DataFrame:
        union = self.tables[0]
        for changes in self.tables[1:]:
            union = union.unionByName(changes)
        return union

    def current(self) -> DataFrame:
        return self.rows().groupBy(*NODE).agg(F.min("label").alias("label"))

    def improve(self, offers: DataFrame) -> int:
        """Writes the offers that beat the label of their node, and only these."""
        known = self.rows().withColumnRenamed("label", "known")
        offered = offers.groupBy(*NODE).agg(F.min("label").alias("label"))
        beaten = offered.join(known, NODE, "left").groupBy(*NODE).agg(
            F.any_value("label").alias("label"), F.min("known").alias("known")
        )
        changes, n = written_counted(beaten.filter(F.col("label") < F.col("known")).select(*NODE, "label"), "changes")
        if n:
            self.tables.append(changes)
        else:
            discard(changes)
        return n

    def merge(self) -> None:
        merged = written(self.current(), "labels")
        for table in self.tables:
            discard(table)
        self.tables = [merged]


def _spread(start: DataFrame, links: DataFrame) -> DataFrame:
    """The lowest label among all nodes that reach each node along ``links``.

    ``start`` has every node with its own label.  Each round changed labels go along the
    links, and then nodes take over the label of the node that their label names.  Where
    labels are in random order, that multiplies the way behind a label in every round.  A
    round writes changed labels only; they are merged every ``MERGE_ROUNDS`` rounds.
    Labels only improve, so the rounds end.
    """
    labels = _Labels(start)
    changed = labels.tables[0]
    rounds = 0
    while True:
        sent = changed.withColumnRenamed("node_id", "src").join(links, ["graph_id", "src"])
        moved = labels.improve(sent.select("graph_id", F.col("dst").alias("node_id"), "label"))
        newest = labels.tables[-1:] if moved else []
        now = labels.current()
        named = now.select("graph_id", F.col("label")["id"].alias("named"), "node_id")
        if labels.improve(named.join(now.withColumnRenamed("node_id", "named"), ["graph_id", "named"])):
            newest.append(labels.tables[-1])
        if not newest:
            break
        changed = newest[0] if len(newest) == 1 else newest[0].unionByName(newest[1])
        rounds += 1
        if rounds % MERGE_ROUNDS == 0:
            changed = written(changed, "changes")
            labels.merge()
    labels.merge()
    return labels.tables[0]


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends in ``nodes``, with the ``first`` of both ends."""

    def end(name: str) -> DataFrame:
        return nodes.select("graph_id", F.col("node_id").alias(name), F.col("first").alias(f"{name}_first"))

    return written(links.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"]), "calls")


def select_entries(
    functions: DataFrame, calls: DataFrame, excluded: Sequence[str] = NON_ENTRIES,
    programs: Sequence[str] = PROGRAMS,
) -> DataFrame:
    """Functions whose cost is the answer, with ``kind`` program, root or cycle.

    ``functions`` is (graph_id, node_id, name) and perhaps ``reads_input``; ``calls`` is
    (graph_id, src, dst).  Where a function named as one of ``programs`` reads input, the
    first of them is the graph's only entry.  Elsewhere the entries are the functions that
    nothing else in the graph calls, drivers in ``excluded`` aside, and one function, the
    first, for each cycle that nothing outside it calls and no such function reaches.

    Functions are put in random order by a hash.  Let u = m(v) be the first one that
    reaches v; what reaches u among the functions with this label is a cycle with u.  A
    link from another label into the cycle means that something outside calls it.  So two
    spreads of labels decide, and no cycle is ever gathered.
    """
    own = functions
    only = None
    if "reads_input" in functions.columns:
        reads = functions.filter(F.col("name").isin(*programs) & F.col("reads_input"))
        only = written(reads.groupBy("graph_id").agg(F.min("node_id").alias("node_id")), "programs")
        own = functions.join(only.select("graph_id"), "graph_id", "left_anti")
    candidates = own.filter(~F.col("name").isin(*excluded)) if excluded else own
    ids = written(candidates.select(*NODE).distinct(), "functions")
    links = written(
        calls.filter(F.col("src") != F.col("dst"))
        .select("graph_id", "src", "dst")
        .distinct()
        .join(ids.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi")
        .join(ids.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi"),
        "calls",
    )
    called = links.select("graph_id", F.col("dst").alias("node_id"), F.lit(1).alias("rank")).distinct()
    # roots come before all others, so whatever a root reaches carries a root's label
    place = F.xxhash64("graph_id", "node_id").alias("place")
    label = F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), place, F.col("node_id").alias("id"))
    first = _spread(ids.join(called, NODE, "left").select(*NODE, label.alias("label")), links)
    at_root = F.col("label")["rank"] == 0
    entries = first.filter(at_root & (F.col("label")["id"] == F.col("node_id"))).select(
        *NODE, F.lit("root").alias("kind")
    )
    outside = F.struct(F.col("label")["place"].alias("place"), F.col("label")["id"].alias("id"))
    left, n = written_counted(first.filter(~at_root).select(*NODE, outside.alias("label")), "left")
    if n:
        named = left.select(*NODE, F.col("label")["id"].alias("first"))
        inner = _within(links, named)
        back = inner.filter(F.col("src_first") == F.col("dst_first")).select(
            "graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")
        )
        own = F.struct(place, F.col("node_id").alias("id"))
        reached = _spread(named.select(*NODE, own.alias("label")), written(back, "calls"))
        members = named.join(reached, NODE).filter(F.col("label")["id"] == F.col("first")).select(*NODE, "first")
        entered = inner.filter(F.col("src_first") != F.col("dst_first")).select(
            "graph_id", F.col("dst").alias("node_id")
        ).distinct()
        outer = members.join(entered, NODE, "left_semi").select("graph_id", "first").distinct()
        cycles = members.join(outer, ["graph_id", "first"], "left_anti").groupBy("graph_id", "first").agg(
            F.min("node_id").alias("node_id")
        )
        entries = entries.unionByName(cycles.select(*NODE, F.lit("cycle").alias("kind")))
    if only is not None:
        entries = entries.unionByName(only.select(*NODE, F.lit("program").alias("kind")))
    return entries
