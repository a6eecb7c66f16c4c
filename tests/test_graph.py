"""Trees, derived edges, features and entries on hand-made graphs."""

import numpy as np
import pytest

from rankwell.operators import graph, message

NODES = "graph_id long, node_id long, symbol string, line int, column int, text string"
EDGES = "graph_id long, src long, dst long, kind string"


def tree(spark, parents, symbols, texts=None):
    """One graph from parent positions and symbols in document order."""
    texts = texts or {}
    nodes = [(1, i, s, i, 0, texts.get(i, "")) for i, s in enumerate(symbols)]
    edges = [(1, p, i, "AST_CHILD") for i, p in enumerate(parents) if p is not None]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


@pytest.fixture(scope="module")
def nested(spark):
    # f: loop(0) { x, loop(1) { x, y, alloc } , y } , g(x, x)
    symbols = ["FUNC_DEF", "LOOP_N_BOUND", "IDENT", "LOOP_HALVING", "IDENT", "IDENT",
               "ARRAY_ALLOC", "IDENT", "FUNC_DEF", "IDENT", "IDENT", "RECURSE"]
    parents = [None, 0, 1, 1, 3, 3, 3, 1, 0, 8, 8, 0]
    texts = {2: "x", 4: "x", 5: "y", 7: "y", 9: "x", 10: "x"}
    return tree(spark, parents, symbols, texts)


def test_loop_carry_reaches_both_loops(nested):
    got = {(r.src, r.dst) for r in graph.loop_carry_edges(*nested).collect()}
    assert got == {(1, 2), (1, 4), (1, 5), (1, 7)}


def test_use_chains_stop_at_a_nested_function(nested):
    walked = graph.walk(*nested)
    got = {(r.src, r.dst) for r in graph.data_dependency_edges(walked).collect()}
    assert got == {(2, 4), (5, 7), (9, 10)}


def test_siblings(nested):
    got = {(r.src, r.dst) for r in graph.sibling_edges(*nested).collect()}
    assert got == {(1, 8), (8, 11), (2, 3), (3, 7), (4, 5), (5, 6), (9, 10)}


def test_features_and_rule(nested):
    row = graph.rule_prediction(graph.tabular_features(*nested)).first()
    assert (row.max_loop_nesting_depth, row.loop_count, row.loop_count_depth_0) == (2, 2, 1)
    assert (row.max_alloc_nesting_depth, row.alloc_inside_loop_count) == (2, 1)
    assert (row.recursion_shape, row.node_count, row.edge_count) == ("single", 12, 11)
    assert (row.rule_time, row.rule_space) == ("O(n^2)", "O(n^2)")


def test_deep_loops_cap_in_the_last_bucket(spark):
    row = graph.tabular_features(*tree(spark, [None, 0, 1, 2, 3], ["LOOP_N_BOUND"] * 5)).first()
    assert (row.max_loop_nesting_depth, row.loop_count_depth_3) == (5, 2)


def test_empty_graph_becomes_one_unknown_node(spark, nested):
    graphs = spark.createDataFrame([(1,), (2,)], "graph_id long")
    got = graph.encoded_nodes(graphs, nested[0]).filter("graph_id = 2").collect()
    assert [(r.node_id, r.symbol_id) for r in got] == [(0, len(graph.SYMBOLS) - 1)]


def test_families_partition_the_features():
    named = sorted(f for members in graph.FEATURE_FAMILIES.values() for f in members)
    assert named == sorted(graph.FEATURES)


def test_signature_ignores_names_and_sees_structure(spark, nested):
    nodes, edges = nested
    place = lambda n: graph.local_index(n)
    base = graph.structure_signature(place(nodes), edges).first().signature
    from pyspark.sql import functions as F

    renamed = graph.structure_signature(place(nodes.withColumn("text", F.lit("z"))), edges)
    assert renamed.first().signature == base
    other = nodes.replace({"RECURSE": "CALL"}, subset=["symbol"])
    assert graph.structure_signature(place(other), edges).first().signature != base


def entries(spark, names, calls):
    functions = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)],
                                      "graph_id long, node_id long, name string")
    links = spark.createDataFrame([(1, a, b) for a, b in calls], "graph_id long, src long, dst long")
    got = graph.select_entries(functions, links, excluded=("main",)).collect()
    return {(r.node_id, r.kind) for r in got}


def test_entries(spark):
    assert entries(spark, ["f", "g", "main"], [(0, 1), (0, 0), (2, 0)]) == {(0, "root")}
    assert entries(spark, ["a", "b"], [(0, 1), (1, 0)]) == {(0, "cycle")}
    # the cycle c-d is entered by a-b, and e is a root of its own
    assert entries(spark, ["a", "b", "c", "d", "e"],
                   [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)]) == {(0, "cycle"), (4, "root")}
    # a low-numbered cycle fed by a high-numbered one
    assert entries(spark, ["a", "b", "c", "d"],
                   [(0, 1), (1, 0), (2, 3), (3, 2), (2, 0)]) == {(2, "cycle")}


def test_calls_resolve_by_name_then_tail(spark):
    definitions = spark.createDataFrame(
        [(1, "fib", 5), (1, "fib", 3), (1, "a.b", 9)], "graph_id long, name string, node_id long")
    calls = spark.createDataFrame(
        [(1, 10, "fib"), (1, 11, "this->fib"), (1, 12, "a.b"), (1, 13, "x.y")],
        "graph_id long, node_id long, callee string")
    got = {(r.src, r.dst) for r in graph.resolve_calls(definitions, calls).collect()}
    assert got == {(10, 3), (11, 3), (12, 9)}


def test_message_round_matches_numpy(spark):
    rng = np.random.default_rng(0)
    size, count = 4, 6
    x = rng.normal(size=(count, size))
    links = [(0, 1, "A"), (2, 1, "A"), (3, 1, "B"), (1, 4, "B")]
    w = message.LayerWeights(
        rng.normal(size=(size, size)), rng.normal(size=size),
        {k: (rng.normal(size=(size, size)), rng.normal(size=size)) for k in "AB"},
        rng.normal(size=size), rng.normal(size=size),
    )
    out = x @ w.own.T + w.own_bias
    for a, b, k in links:
        out[b] += x[a] @ w.by_kind[k][0].T + w.by_kind[k][1]
    norm = (out - out.mean(1, keepdims=True)) / np.sqrt(out.var(1, keepdims=True) + 1e-5)
    want = np.maximum(norm * w.gamma + w.beta, 0)
    vectors = spark.createDataFrame(
        [(1, i, [float(v) for v in x[i]]) for i in range(count)],
        "graph_id long, node_id long, x array<double>")
    edges = spark.createDataFrame([(1, a, b, k) for a, b, k in links], EDGES)
    got = {r.node_id: r.x for r in message.message_round(vectors, edges, w).collect()}
    assert np.allclose([got[i] for i in range(count)], want, atol=1e-9)
    pooled = message.readout(vectors, size, "meanmax").first().pooled
    assert np.allclose(pooled, np.concatenate([x.mean(0), x.max(0)]))


def chain_tree(spark, depth):
    """A path of loops with an identifier x below every thousandth."""
    parents, symbols, texts = [None], ["FUNC_DEF"], {}
    at = 0
    for i in range(depth):
        parents.append(at)
        symbols.append("LOOP_N_BOUND" if i % 4000 == 0 else "BLOCK")
        at = len(symbols) - 1
        if i % 3000 == 2999:
            parents.append(at)
            symbols.append("IDENT")
            texts[len(symbols) - 1] = "x"
    return tree(spark, parents, symbols, texts)


def test_a_path_deeper_than_ten_thousand_levels(spark):
    nodes, edges = chain_tree(spark, 12_500)
    walked = graph.walk(nodes, edges)
    assert walked.agg({"level": "max"}).first()[0] == 12_500
    loops = {r.node_id: r.level for r in walked.filter("symbol LIKE 'LOOP%'").collect()}
    idents = {r.node_id: r.level for r in walked.filter("symbol = 'IDENT'").collect()}
    want = {
        (a, b) for a, la in loops.items() for b in idents
        if la < idents[b] and sum(la < lb for lb in idents.values()) > 1
    }
    got = {(r.src, r.dst) for r in graph.loop_carry_edges(nodes, edges).collect()}
    assert got == want and want


def random_forest(rnd, n):
    symbols = ["FUNC_DEF"] + [
        rnd.choice(["FUNC_DEF", "LOOP_N_BOUND", "LOOP_HALVING", "BLOCK", "IDENT", "IDENT"]) for _ in range(n - 1)
    ]
    parents = [None] + [None if rnd.random() < 0.05 else rnd.randrange(max(0, i - 6), i) for i in range(1, n)]
    texts = {i: rnd.choice("abcdefgh") for i in range(n) if symbols[i] == "IDENT"}
    return parents, symbols, texts


def test_closures_equal_brute_force(spark):
    import random

    parents, symbols, texts = random_forest(random.Random(1), 160)
    nodes, edges = tree(spark, parents, symbols, texts)

    def above(i):
        steps = 0
        while parents[i] is not None:
            i, steps = parents[i], steps + 1
            yield i, steps

    every = {(a, i, d) for i in range(160) for a, d in above(i)}
    by_loops = {p for p in every if symbols[p[0]].startswith("LOOP")}
    loops = nodes.filter("symbol LIKE 'LOOP%'")
    got = {(r.root, r.node_id, r.depth) for r in graph.descendants(nodes, edges, loops).collect()}
    assert got == by_loops
    bounded = set()
    for i in range(160):
        for a, d in above(i):
            bounded.add((a, i, d))
            if symbols[a] == "FUNC_DEF":
                break
    # functions and loops as roots, and no entering of functions
    of = nodes.filter("symbol LIKE 'LOOP%' OR symbol = 'FUNC_DEF'")
    got = {(r.root, r.node_id, r.depth) for r in graph.descendants(nodes, edges, of, "FUNC_DEF").collect()}
    assert got == {p for p in bounded if symbols[p[0]] in ("FUNC_DEF", "LOOP_N_BOUND", "LOOP_HALVING")}
    below = {}
    for a, i, _ in by_loops:
        if i in texts:
            below.setdefault((a, texts[i]), set()).add(i)
    want = {(a, i) for (a, _), ids in below.items() if len(ids) > 1 for i in ids}
    assert {(r.src, r.dst) for r in graph.loop_carry_edges(nodes, edges).collect()} == want
    level = {r.node_id: (r.level, r.loop_depth, r.scope) for r in graph.walk(nodes, edges).collect()}
    for i in range(160):
        chain = [a for a, _ in above(i)]
        scope = next((a for a in chain if symbols[a] == "FUNC_DEF"), None)
        assert level[i] == (len(chain), sum(symbols[a].startswith("LOOP") for a in chain), scope)


def test_no_pairs_without_an_identifier(spark):
    """Ten thousand nodes below nested loops, two of them names: four pairs are written."""
    parents = [None, 0, 1] + [2] * 10_000
    symbols = ["FUNC_DEF", "LOOP_N_BOUND", "LOOP_N_BOUND"] + ["CALL"] * 9_998 + ["IDENT"] * 2
    texts = {10_001: "x", 10_002: "x"}
    nodes, edges = tree(spark, parents, symbols, texts)
    sizes = []
    original = graph.written

    def counting(frame, name):
        out = original(frame, name)
        if name == "loop_pairs":
            sizes.append(out.count())
        return out

    graph.written = counting
    try:
        assert graph.loop_carry_edges(nodes, edges).count() == 4
    finally:
        graph.written = original
    assert sizes == [4]


def test_nodes_reached_twice_are_errors(spark):
    symbols = ["FUNC_DEF", "BLOCK", "BLOCK", "BLOCK"]
    nodes, edges = tree(spark, [None, 0, 3, 2], symbols)
    with pytest.raises(ValueError, match="cycle"):
        graph.walk(nodes, edges)
    nodes, edges = tree(spark, [None, 0, 0, 1], symbols)
    twice = edges.union(spark.createDataFrame([(1, 2, 3, "AST_CHILD")], EDGES))
    with pytest.raises(ValueError, match="two parents"):
        graph.walk(nodes, twice)


def brute_entries(n, calls):
    calls = {(a, b) for a, b in calls if a != b}
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in calls:
            reach[a] |= reach[b]
    roots = {i for i in range(n) if not any(b == i for _, b in calls)}
    left = set(range(n)) - {v for r in roots for v in reach[r]}
    groups = {i: {j for j in left if j in reach[i] and i in reach[j]} for i in left}
    cycles = {
        i for i in left if i == min(groups[i]) and not any(b in groups[i] and a not in groups[i] for a, b in calls)
    }
    return {(i, "root") for i in roots} | {(i, "cycle") for i in cycles}


def test_entries_equal_brute_force(spark):
    import random

    rnd = random.Random(8)
    functions, links, want = [], [], set()
    for g in range(40):
        n = rnd.randrange(1, 25)
        calls = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(0, 2 * n))]
        functions += [(g, i, f"f{i}") for i in range(n)]
        links += [(g, a, b) for a, b in calls]
        want |= {(g, *e) for e in brute_entries(n, calls)}
    # one long cycle against the order of the ids, fed by a later one
    n = 40
    calls = [(i + 1, i) for i in range(n - 1)] + [(0, n - 1), (n + 1, 5), (n, n + 1), (n + 1, n)]
    functions += [(99, i, f"f{i}") for i in range(n + 2)]
    links += [(99, a, b) for a, b in calls]
    want.add((99, n, "cycle"))
    got = graph.select_entries(
        spark.createDataFrame(functions, "graph_id long, node_id long, name string"),
        spark.createDataFrame(links, "graph_id long, src long, dst long"),
    ).collect()
    assert {(r.graph_id, r.node_id, r.kind) for r in got} == want


def test_a_program_that_reads_input_is_the_only_entry(spark):
    functions = spark.createDataFrame(
        [(1, 0, "f", False), (1, 1, "main", True), (1, 2, "main", True), (2, 0, "f", True), (2, 1, "main", False),
         (3, 0, "Main", True), (4, 0, "setUp", True)],
        "graph_id long, node_id long, name string, reads_input boolean")
    links = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "graph_id long, src long, dst long")
    got = {(r.graph_id, r.node_id, r.kind) for r in graph.select_entries(functions, links).collect()}
    assert got == {(1, 1, "program"), (2, 0, "root"), (3, 0, "program")}


def test_label_spread_writes_changes_only(spark):
    """Along a path of 300 the rows written stay far below rounds x nodes."""
    # the link order is against the ids, the label order is random
    nodes = spark.range(300).selectExpr(
        "1L AS graph_id", "id AS node_id", "struct(xxhash64(id) AS place, id AS id) AS label")
    links = spark.range(299).selectExpr("1L AS graph_id", "id + 1 AS src", "id AS dst")
    rows = []
    original = graph.written_counted

    def counting(frame, name, test=None):
        out = original(frame, name, test)
        rows.append(out[1])
        return out

    graph.written_counted = counting
    try:
        got = graph._spread(nodes, links)
    finally:
        graph.written_counted = original
    label = {r.node_id: r.label for r in nodes.collect()}
    want = {i: min(label[j] for j in range(i, 300)) for i in range(300)}
    assert {r.node_id: r.label for r in got.collect()} == want
    assert len(rows) < 60 and sum(rows) < 300 * len(rows) / 3  # not 300 rounds, not all rows


@pytest.mark.parametrize("piece", [2, 3, 1000])
def test_no_gram_is_lost_at_a_cut(spark, piece):
    import random
    from collections import Counter

    rnd = random.Random(piece)
    rows, want = [], Counter()
    for g, size in enumerate((1, 2, 3, 20, 41)):
        symbols = [rnd.choice("ABC") for _ in range(size)]
        rows += [(g, i, s) for i, s in enumerate(symbols)]
        want.update((g, " ".join(symbols[i : i + k])) for k in (1, 2, 3) for i in range(size - k + 1))
    placed = spark.createDataFrame(rows, "graph_id long, position long, symbol string")
    got = {(r.graph_id, r.gram): r.n for r in graph.symbol_grams(placed, piece).collect()}
    assert got == dict(want)
