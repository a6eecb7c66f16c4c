"""The skew-safe building blocks against brute force, with one hot key."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankwell.functions import skew


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        out.append((key, i * 7 % 3001, rng.randrange(50), rng.random()))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, pos long, w long, v double").repartition(5)


def groups(rows):
    out = {}
    for k, pos, w, v in rows:
        out.setdefault(k, []).append((pos, w, v))
    return {k: sorted(g) for k, g in out.items()}


def test_keep_lowest(frame, rows):
    got = skew.keep_lowest(frame, ["k"], [F.col("pos")], 4, salts=8).collect()
    want = {(k, p) for k, g in groups(rows).items() for p, _, _ in g[:4]}
    assert {(r.k, r.pos) for r in got} == want and len(got) == len(want)


def test_running_total_over_nested_blocks(frame, rows):
    blocks = [F.shiftright("pos", 8), F.shiftright("pos", 4)]
    got = skew.running_total(frame, ["k"], blocks, [F.col("pos")], F.col("w")).collect()
    want = {}
    for k, g in groups(rows).items():
        for (p, _, _), total in zip(g, np.cumsum([w for _, w, _ in g]), strict=True):
            want[(k, p)] = total
    assert {(r.k, r.pos): r.running for r in got} == want


def test_next_in_group(frame, rows):
    got = skew.next_in_group(frame, ["k"], "pos", F.shiftright("pos", 5)).collect()
    want = {}
    for k, g in groups(rows).items():
        places = [p for p, _, _ in g]
        want |= {(k, a): b for a, b in zip(places, [*places[1:], None], strict=True)}
    assert {(r.k, r.pos): r.next for r in got} == want


def test_value_at_ranks_is_exact(frame, rows):
    n = F.col("_n")
    ranks = [("low", F.floor((n + 1) / 2)), ("high", F.floor(n / 2) + 1), ("last", n)]
    got = {r.k: r for r in skew.value_at_ranks(frame, ["k"], "v", ranks, steps=16).collect()}
    for k, g in groups(rows).items():
        values = sorted(v for _, _, v in g)
        assert (got[k].low + got[k].high) / 2 == pytest.approx(np.median(values))
        assert got[k].last == values[-1] and got[k].n == len(values)


def test_value_at_ranks_with_one_value(spark):
    frame = spark.createDataFrame([(5.0,)] * 9, "v double")
    row = skew.value_at_ranks(frame, [], "v", [("q", F.lit(9))]).first()
    assert row.q == 5.0


def test_value_at_ranks_with_an_outlier(spark):
    values = [float(i * i) for i in range(3000)] + [1e15, -1e15]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = [("low", F.lit(1)), ("mid", F.floor(F.col("_n") / 2)), ("high", F.col("_n"))]
    row = skew.value_at_ranks(frame, [], "v", ranks, steps=50).first()
    ordered = sorted(values)
    assert (row.low, row.mid, row.high) == (ordered[0], ordered[len(values) // 2 - 1], ordered[-1])


def test_value_at_ranks_of_rows_that_come_in_another_order_each_time(spark):
    def mixed(frames):
        yield pd.concat(frames).sample(frac=1.0)

    # approximate quantiles depend on the order in which rows come
    n = 800_000
    frame = spark.range(0, n, 1, 4).select("id", (F.col("id") * 7919 % n).alias("v")).mapInPandas(mixed, "id long, v long")
    ranks = [(f"q{i}", F.lit(n * i // 10)) for i in range(1, 10)]
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        row = skew.value_at_ranks(frame, [], "v", ranks, steps=20).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [row[f"q{i}"] for i in range(1, 10)] == [n * i // 10 - 1 for i in range(1, 10)]


def test_numbered_follows_the_lines_of_all_files(spark, tmp_path):
    lines = {"a": 30, "b": 5000, "c": 1, "d": 700}
    for name, n in lines.items():
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # several splits of one file
    try:
        scan = spark.read.text(str(tmp_path)).select(
            "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"))
        got = [r.value for r in skew.numbered(scan, "f", "s").orderBy("row_index").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"{name} {i}" for name, n in lines.items() for i in range(n)]


def test_lowest_hash(spark):
    frame = spark.range(5000).select(
        F.col("id"), (F.abs(F.xxhash64("id")) % (1 << 48)).alias("b")
    )
    want = sorted((r.b, r.id) for r in frame.collect())[:700]
    got = skew.lowest_hash(frame, "b", ["id"], F.lit(700), ranges=64).collect()
    assert sorted((r.b, r.id) for r in got) == want
