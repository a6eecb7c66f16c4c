"""Hard negatives against all pairs, and the pruning against plain products."""

import math
import random

import numpy as np
import pytest

from rankwell.llm.hard_negatives import Anchors, Bucket, hard_negatives, mined_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, akey bigint, part int, v string, bounds string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)


def brute(rows, every=50, k=5, m=3, low=50, high=95):
    fit = []
    for vec_id, vector, label in dict.fromkeys((i, None if v is None else tuple(v), lb) for i, v, lb in rows):
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        fit.append((vec_id, [math.floor(256 * x) for x in vector], label))
    fit = [list(t) for t in {(i, tuple(v), lb) for i, v, lb in fit}]
    out = []
    for a, (anchor, q, label) in enumerate(fit):
        if anchor % every:
            continue
        scored = sorted(
            (-max(-(1 << 63), min((1 << 63) - 1, sum(map(int.__mul__, q, v)))), i, lb)
            for c, (i, v, lb) in enumerate(fit) if c != a and len(v) == len(q)
        )
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            window = [s for s in scored if s[2] != label and -low * p <= -100 * s[0] <= -high * p][:m]
            out += [(anchor, positive, r, i, -p, -s) for r, (s, i, _) in enumerate(window, 1)]
    return sorted(out)


def vectors(rnd, n, dim, spread):
    """Clusters of directions with lengths from short to long."""
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    out = []
    for i in range(n):
        centre = rnd.choice(centres)
        length = rnd.choice((0.01, 0.3, 1.0, 1.0, 4.0))
        out.append((i, [length * (c + rnd.gauss(0, spread)) for c in centre], rnd.randrange(4)))
    return out


@pytest.mark.parametrize("spread", [0.05, 0.5, 3.0])
def test_equals_all_pairs(spark, spread):
    rows = vectors(random.Random(11), 1500, 24, spread)
    got = sorted(map(tuple, hard_negatives(frame(spark, rows)).collect()))
    assert got == brute(rows)


def test_odd_rows(spark):
    rnd = random.Random(4)
    rows = vectors(rnd, 400, 6, 0.3)
    rows += [(50, rows[50][1], rows[50][2])] * 3 + [(50, rows[51][1], 2), (50, [0.0] * 6, 1), (100, [], 1), (3, [], 1), (4, [], 2)]
    rows += [(i, [-x for x in rows[0][1]], 3) for i in range(600, 640)]  # ties
    rows += [(700, None, 1), (750, [1.0, None, 1.0, 0.0, 0.0, 0.0], 1), (800, [float("nan")] * 6, 1)]
    rows += [(850, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (900, [1.0] * 6, None), (950, [0.5] * 3, 2)]
    rows += [(1000, [1e9] * 6, 0), (1001, [9e8] * 6, 0), (1002, [8e8] * 6, 1)]  # beyond exact floats
    rnd.shuffle(rows)
    assert sorted(map(tuple, hard_negatives(frame(spark, rows)).collect())) == brute(rows)
    moved = [(i, v, lb if lb is None or i is None or i % 7 else (lb + 1) % 10) for i, v, lb in rows]
    assert sorted(map(tuple, mined_negatives(frame(spark, rows)).collect())) == brute(moved)


def test_hot_label_and_anchor_only_table(spark):
    rnd = random.Random(9)
    rows = [(50 * i, [rnd.gauss(0, 1) for _ in range(8)], 0 if i % 3 else i % 7) for i in range(300)]
    assert sorted(map(tuple, hard_negatives(frame(spark, rows)).collect())) == brute(rows)


def test_empty(spark):
    assert hard_negatives(frame(spark, [])).collect() == []


def test_pruning_loses_no_row_and_prunes():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 32))
    x = np.floor(256 * (centres[rng.integers(0, 8, 512)] + 0.1 * rng.normal(size=(512, 32))))
    q = np.floor(256 * (centres[rng.integers(0, 8, 40)] + 0.1 * rng.normal(size=(40, 32))))
    bucket = Bucket(x, np.arange(512), np.zeros(512, np.int64), np.linalg.norm(x, axis=1))
    anchors = Anchors(q, np.arange(40), np.zeros(40, np.int64), np.zeros(40, np.int64))
    scores = q @ x.T
    for share in (0.0, 0.3, 0.8, 0.95):
        floor = share * scores.max(axis=1)
        pairs = {(int(i), int(r)) for a, b in bucket.candidates(anchors, floor) for i, r in zip(a, b, strict=True)}
        want = {tuple(map(int, p)) for p in np.argwhere(scores >= floor[:, None])}
        assert want <= pairs
        assert share < 0.8 or len(pairs) < 0.3 * scores.size
