"""Text variants, the limiter and the metrics."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rankwell.functions import text
from rankwell.functions import variants as tv
from rankwell.operators import serve, variants
from rankwell.streaming import limiter, metrics
from rankwell.streaming.limiter import Bucket, limit_requests, limit_stream
from rankwell.streaming.scoring import run_to_folder


def one(spark, column, code, language="python"):
    frame = spark.createDataFrame([(code, language)], "code string, language string")
    return frame.select(column(F.col("code"), F.col("language")).alias("x")).first().x


def test_comments(spark):
    got = one(spark, tv.add_comments, "a = 1\n\n# c\nb \\\n  d")
    assert got == "# perturbation: comment header\na = 1  # note\n\n# c\nb \\\n  d  # note\n"
    assert one(spark, tv.add_comments, "#include <x>\nint a;\n", "cpp").splitlines()[1:] == [
        "#include <x>", "int a;  // note"]


def test_reformat(spark):
    assert one(spark, tv.reformat_whitespace, "def f():\n  x = 1  \n") == "def f():\n    x = 1\n"
    assert one(spark, tv.reformat_whitespace, "  a;\n\tb;\n", "go") == "a;\nb;\n"
    assert one(spark, tv.reformat_whitespace, "a;\n", "go") is None


def test_filler(spark):
    assert one(spark, tv.add_filler(2), "x") == "pad0 = 0\npad1 = pad0 + 1\nx\n"
    assert one(spark, tv.add_filler(1), "x\r\ny", "cpp") == "int pad0 = 0;\nx\ny\n"
    assert one(spark, tv.add_filler(1), "", "go") == "pad0 := 0\n"
    assert one(spark, tv.add_filler(1), "x", "rust") is None
    assert one(spark, tv.insert_unused_helper, "x", "java") is None


def test_augment_cycles_the_sizes(spark):
    rows = [(i * 3, f"s{i}", "python" if i != 2 else "rust", "x") for i in range(4)]
    frame = spark.createDataFrame(rows, "input_pos long, solution_id string, language string, code string")
    ids = {r.solution_id for r in variants.augment(frame).collect()}
    assert ids == {"s0", "s1", "s2", "s3", "s0+pad10", "s1+pad40", "s3+pad40"}


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_limiter_against_a_walk(spark):
    import random

    rng = random.Random(1)
    rows, clock = [], 0.0
    for i in range(800):
        clock += rng.choice([0.0, 0.1, 0.5, 1.0, 3.0, 60.0 if rng.random() < 0.1 else 0.2])
        rows.append((i, "hot" if rng.random() < 0.5 else f"u{i % 3}", at(clock), rng.random() < 0.9))
    want, state = {}, {}
    for i, user, ts, counts in rows:
        if not counts:
            want[i] = True
            continue
        now = (ts - datetime.datetime(2024, 1, 1)).total_seconds()
        tokens, last = state.get(user, (5.0, now))
        tokens = min(5.0, tokens + (now - last) * 0.5)
        want[i] = tokens >= 1
        state[user] = (tokens - want[i], now)
    frame = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp, counts boolean")
    got = limit_requests(frame, Bucket(capacity=5.0, refill=0.5)).collect()
    assert {r.event_id: r.allowed for r in got} == want
    assert not all(want.values())


@pytest.mark.parametrize("in_order", [True, False])
def test_stream_loses_no_request(spark, tmp_path, in_order):
    schema = "event_id long, user_id string, ts timestamp, counts boolean"
    rows = [(i, f"u{i % 3}", at(3 * i), True) for i in range(200)]
    parts = [rows[k : k + 40] for k in range(0, 200, 40)] if in_order else [rows[k::5] for k in range(5)]
    for k, part in enumerate(parts if in_order else reversed(parts)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bucket = Bucket(capacity=5.0, refill=0.05)
    got = spark.read.parquet(run_to_folder(limit_stream(stream, bucket), "test")).collect()
    assert sorted(r.event_id for r in got) == list(range(200))
    assert len({r.batch for r in got}) == 5
    if in_order:
        batch = limit_requests(spark.createDataFrame(rows, schema), bucket).collect()
        assert {r.event_id: r.allowed for r in got} == {r.event_id: r.allowed for r in batch}
        assert len({r.allowed for r in got}) == 2


def test_latency_buckets_are_cumulative(spark):
    frame = spark.createDataFrame([(0.02,), (0.3,), (9.0,)], "s double")
    rows = metrics.histogram_rows(metrics.latency_totals(frame, F.col("s"))).collect()
    assert [r.n for r in rows] == [1, 1, 1, 2, 2, 2, 2, 3] and rows[-1].le == "+Inf"


def test_request_checks_count_bytes(spark):
    frame = spark.createDataFrame([("é" * 3, "python"), ("a", "rust"), ("a", "auto")], "c string, l string")
    got = [r.x for r in frame.select(
        text.reject_reason(F.col("c"), F.col("l"), max_bytes=5).alias("x")).collect()]
    assert got == ["code exceeds the 5-byte cap", "unsupported language: 'rust'", None]


@pytest.mark.parametrize(("path", "language"), [
    ("a/b.PY", "python"), ("x.tar.kts", "kotlin"), (".py", None), ("README", None), ("a.b/c", None)])
def test_language_of_path(spark, path, language):
    assert spark.range(1).select(text.language_of_path(F.lit(path)).alias("x")).first().x == language


def test_rules_first_match_wins(spark):
    rules = [("^min$", "A"), ("m", "B"), ("^drop$", "")]
    arity = [("^max$", {"one": "LINEAR", "many": "CONST"})]
    frame = spark.createDataFrame(
        [("max", 1), ("max", 2), ("min", 2), ("m", 0), ("drop", 1), ("zz", 1)], "n string, a int")
    got = [r.x for r in frame.select(text.first_rule(F.col("n"), F.col("a"), arity, rules).alias("x")).collect()]
    assert got == ["LINEAR", "CONST", "A", "B", None, "CALL"]


def test_top_contributions(spark):
    frame = spark.createDataFrame([(2.0, 3.0, 0.0)], "a double, b double, c double")
    weights = F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.5), F.lit("c"), F.lit(0.1))
    scales = F.create_map(F.lit("b"), F.lit(6.0))
    got = frame.select(serve.top_contributions(frame, ["a", "b", "c"], weights, scales).alias("x")).first().x
    assert [tuple(r) for r in got] == [("a", 1.0), ("b", 0.25)]


def test_block_maps_equal_a_walk_from_every_credit():
    rng = random.Random(5)
    for _ in range(200):
        credit = limiter.Credit.of(Bucket(capacity=rng.choice([1, 2.5, 4]), refill=rng.choice([0.5, 0.3]), time_scale=1e-5))
        times = [rng.randrange(300)]
        for _ in range(rng.randrange(40)):
            times.append(times[-1] + rng.choice([0, 0, 3, 11, 40]))
        whole = limiter.block_map(times, credit)
        cut = rng.randrange(len(times) + 1)
        gap = [times[cut - 1]] if 0 < cut < len(times) else []
        parts = [limiter.block_map(times[:cut], credit)] + (
            [limiter._gap_map(gap, times[cut:], credit)] if cut < len(times) else [])
        for start in [0, credit.full, *(rng.randrange(credit.full + 1) for _ in range(60))]:
            want = credit.decided(times, start, None)[1]
            assert limiter.mapped(whole, start) == want
            through = start
            for part in parts:
                through = limiter.mapped(part, through)
            assert through == want
            if len(parts) == 2:
                assert limiter.mapped(limiter.composed(*parts), start) == want


def test_block_maps_stay_short():
    rng = random.Random(6)
    credit = limiter.Credit.of(Bucket(capacity=20.0, refill=0.5))
    for widest in (400_000, 1_000_000, 4_000_000):
        times = [0]
        for _ in range(4000):
            times.append(times[-1] + rng.randrange(widest))
        assert len(limiter.block_map(times, credit)) <= 22


def test_one_client_of_a_million_requests_is_spread(spark):
    """A client that never pauses, among others: sixteen ranges, the flags of one walk."""
    n = 1_000_000
    log = spark.range(n, numPartitions=8).selectExpr(
        "id AS event_id", "IF(id % 50 = 0, concat('u', id % 7), 'hot') AS user_id",
        "timestamp_micros(id * 400000 + (id * id) % 1000) AS ts", "id % 11 <> 0 AS counts")
    bucket = Bucket(capacity=20.0, refill=0.5)
    got = limiter.limit_requests(log, bucket, parts=16)
    seen = []
    original = limiter.written

    def watching(frame, name):
        out = original(frame, name)
        if name == "requests":
            seen.append(out.filter("owner = 'hot'").select("part").distinct().count())
        return out

    limiter.written = watching
    try:
        got = limiter.limit_requests(log, bucket, parts=16)
    finally:
        limiter.written = original
    assert seen and seen[0] >= 15
    credit = limiter.Credit.of(bucket)
    times = {}
    for i in range(n):
        if i % 11:
            times.setdefault(f"u{i % 7}" if i % 50 == 0 else "hot", []).append(i * 400000 + (i * i) % 1000)
    want = {u: sum(credit.decided(sorted(t), credit.full, None)[0]) for u, t in times.items()}
    counted = got.filter("counts").groupBy("user_id").agg(F.count_if("allowed").alias("n")).collect()
    assert {r.user_id: r.n for r in counted} == want
    assert got.filter("NOT counts AND NOT allowed").isEmpty() and got.count() == n


def test_lines_of_long_strings_and_comments_stay(spark):
    python = 'a = 1\nb = """x\n  y  \n"""  \nc = "#" \n# it\'s """\n  d = 2  \n'
    assert one(spark, tv.add_comments, python).split("\n")[1:] == [
        "a = 1  # note", 'b = """x', "  y  ", '"""  ', 'c = "#"   # note', "# it's \"\"\"", "  d = 2    # note", ""]
    assert one(spark, tv.reformat_whitespace, python) == (
        'a = 1\nb = """x\n  y  \n"""  \nc = "#"\n# it\'s """\n    d = 2\n')
    cpp = 'int a; // "/*"\n/* one\n   two */ int b;\n  char* c = "/*";\n  int d;\n'
    assert one(spark, tv.reformat_whitespace, cpp, "cpp") == (
        'int a; // "/*"\n/* one\n   two */ int b;\nchar* c = "/*";\nint d;\n')
    go = 'x := `a\n  b` // c\n  y := "`"\n'
    assert one(spark, tv.reformat_whitespace, go, "go") == 'x := `a\n  b` // c\ny := "`"\n'
    quoted = "s = 'it\\'s \\\\' \n" + 't = "\\"" \n'
    assert one(spark, tv.reformat_whitespace, quoted) == "s = 'it\\'s \\\\'\n" + 't = "\\""\n'


def test_helpers_of_go_and_java(spark):
    go = "package p\n\nvar s = `\nfunc no()`\n\nfunc main() {}\n"
    assert one(spark, tv.insert_unused_helper, go, "go") == go.replace(
        "func main", tv.HELPERS["go"] + "func main")
    assert one(spark, tv.insert_unused_helper, "package p\n", "go") is None
    java = "import x;\n/*\nclass No {}\n*/\npublic final class A extends B {\n  int c;\n}\nclass D {}\n"
    assert one(spark, tv.insert_unused_helper, java, "java") == java.replace(
        "extends B {", "extends B {" + tv.HELPERS["java"])
    assert one(spark, tv.insert_unused_helper, "interface X {}", "java") is None


def test_long_texts_are_scanned_in_linear_time(spark):
    import time

    begin = time.time()
    for unit, language in (("'", "python"), ('"""', "python"), ('"\\"', "java"), ("/*", "cpp"), ("`a\n", "go"), ("x = 'a\\'b' # c\n", "python")):
        one(spark, tv.add_comments, unit * 60_000, language)
    assert time.time() - begin < 60
