"""A message round groups its messages once for all edge kinds."""

import numpy as np

from rankwell.operators import message


def test_round_groups_once_and_adds_up_by_kind(spark):
    vectors = spark.createDataFrame(
        [(1, n, [float(n), 1.0]) for n in range(4)], "graph_id bigint, node_id bigint, x array<double>"
    )
    edges = spark.createDataFrame(
        [(1, 0, 3, "a"), (1, 1, 3, "a"), (1, 2, 3, "b"), (1, 2, 0, "c")], "graph_id bigint, src bigint, dst bigint, kind string"
    )
    sums = message.incoming_sums(vectors, edges, 2, ["a", "b"])
    got = {r["node_id"]: (r["counts"], r["totals"]) for r in sums.collect()}
    assert got[3] == ([2.0, 1.0], [1.0, 2.0, 2.0, 1.0])
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    one, none = np.eye(2), np.zeros(2)
    weights = message.LayerWeights(one, none, {"a": (one, none), "b": (2 * one, none)}, np.ones(2), none)
    after = message.message_round(vectors, edges, weights)
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    out = {r["node_id"]: r["x"] for r in after.collect()}
    # node 3: [3, 1] + [1, 2] + 2 * [2, 1] = [8, 5], normalised
    assert np.allclose(out[3], [1.0, 0.0], atol=1e-4) and np.allclose(out[0], [0.0, 1.0], atol=1e-4)
