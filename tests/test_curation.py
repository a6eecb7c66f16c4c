"""Ingest, dedupe, caps and splits on the small published cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rankwell.functions.hashing import stable_bucket
from rankwell.functions.ordinal import TIME_CLASSES, ordinal_distance, rank_of, rounded_class
from rankwell.operators import curate, describe
from rankwell.plans.corpus_build import build_corpus
from rankwell.sources import cases, corpus_files, ingest

SCHEMA = (
    "input_pos long, problem_id string, solution_id string, source string, language string, "
    "code string, time_class string, space_class string, signature string"
)


def record(i, problem="p", source="s", code=None, time="O(n)", space=None, signature=None):
    return (i, problem, f"{problem}_{i}", source, "python", code or f"c{i}", time, space, signature)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_bucket_of_a_known_key(spark):
    row = spark.range(1).select(
        stable_bucket(F.lit("src0:0")).alias("a"),
        stable_bucket(F.lit("src0:0"), 1_000_003).alias("b"),
    ).first()
    assert (row.a, row.b) == (20, 404537)


def test_nested_ingest_counters(spark):
    labels = spark.createDataFrame(
        [("0", "0_0", "O(n)", "O(1)"), ("0", "0_1", None, None),
         ("0", "0_2", "O(n+m**2)", "O(n**2)"), ("0", "0_3", "O(n)", "O(1)")],
        "problem_id string, solution_id string, time_complexity_inferred string, "
        "space_complexity_inferred string",
    )
    nested = spark.createDataFrame(
        [(0, "0", [("0_0", "a"), ("0_1", "b"), ("0_2", "old"), ("0_2", "c")])],
        "input_pos long, problem_id string, "
        "correct_solution_list array<struct<solution_id:string,solution_code:string>>",
    )
    joined = ingest.join_labels(labels, ingest.explode_solutions(nested), "bigobench", "python")
    assert ingest.ingest_counters(joined).first().asDict() == {
        "kept": 2, "missing_code": 1, "dropped_no_usable_label": 1, "time_null": 1,
        "time_unmapped": 1, "space_null": 1, "space_unmapped": 0,
    }
    kept = {r.solution_id: r for r in joined.filter("outcome = 'kept'").collect()}
    assert kept["0_2"].code == "c" and kept["0_2"].time_class is None
    assert kept["0_2"].space_class == "O(n^2)"


def test_flat_ids_count_dropped_rows(spark):
    rows = spark.createDataFrame(
        [(0, "x", "linear", "0001_A"), (1, "y", "made_up", "0009_Z"), (2, "z", "quadratic", "0002_B")],
        "row_index long, src string, complexity string, problem string",
    )
    got = ingest.flat_records(rows, "codecomplex", "python").filter("time_class is not null")
    assert {(r.solution_id, r.time_class) for r in got.collect()} == {
        ("0001_A_python_0", "O(n)"), ("0002_B_python_2", "O(n^2)"),
    }


def test_strict_mapping_raises(spark):
    rows = spark.createDataFrame([("nope",)], "raw string")
    with pytest.raises(Exception, match="no class for label nope"):
        curate.map_labels(
            rows, "raw", F.lit("a"), {"a": {"x": "O(1)"}}, "class", strict=True
        ).collect()


def test_exact_dedupe_keeps_the_first_of_each_source(spark):
    rows = frame(spark, [record(0, code="x"), record(1, code="x"), record(2, code="x", source="t")])
    assert {r.input_pos for r in curate.exact_dedupe(rows).collect()} == {0, 2}


def test_structure_dedupe(spark):
    rows = frame(spark, [
        record(0, signature="a"), record(1, signature="a"), record(2, signature="a", time="O(1)"),
        record(3, problem="q", signature="a"), record(4), record(5),
    ])
    kept = {r.input_pos for r in curate.structure_dedupe(rows).collect()}
    bucket = lambda i: int(hashlib.sha256(f"s:p_{i}".encode()).hexdigest()[:8], 16) % 1_000_003
    assert kept == {min((0, 1), key=bucket), 2, 3, 4, 5}


def test_caps_and_null_class(spark):
    rows = frame(spark, [record(i, problem=str(i)) for i in range(50)]
                 + [record(i, problem=str(i), time="O(2^n)") for i in range(50, 53)]
                 + [record(i, problem=str(i), time=None) for i in range(53, 70)])
    counts = {r.time_class: r["count"] for r in
              curate.cap_per_class(rows, 10).groupBy("time_class").count().collect()}
    assert counts == {"O(n)": 10, "O(2^n)": 3, None: 10}
    assert curate.cap_per_problem(rows.withColumn("problem_id", F.lit("one")), 7).count() == 7


def test_split_has_no_leak_and_fair_shares(spark):
    rows = frame(spark, [record(i, problem=f"p{i // 5}") for i in range(5000)])
    built = build_corpus(rows)
    assert describe.split_leaks(built).count() == 0
    sizes = {r.split: r.n for r in describe.split_report(built).filter("metric = 'problems'").collect()}
    assert 600 <= sizes["train"] <= 800 and 100 <= sizes["val"] <= 200 and 100 <= sizes["test"] <= 200


def test_hash_sample_equals_a_sort(spark):
    rows = frame(spark, [record(i, problem=f"p{i}") for i in range(500)])
    key = lambda i: int(hashlib.sha256(f"s:p{i}_{i}".encode()).hexdigest()[:12], 16)
    want = set(sorted(range(500), key=key)[:60])
    assert {r.input_pos for r in curate.hash_sample(rows, 60).collect()} == want


def test_corpus_files_round_trip_and_refuse_bad_lines(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    corpus_files.write_corpus(frame(spark, [record(0), record(1, time=None, space="O(1)")]), path)
    back = corpus_files.read_corpus(spark, path).drop("file_name")
    assert sorted(back.collect())[1].time_class is None
    bad = tmp_path / "bad.jsonl"
    bad.write_text('\n{"problem_id": "1"}\n')
    assert corpus_files.invalid_lines(spark, str(bad)).count() == 1
    with pytest.raises(Exception, match="not a corpus record"):
        corpus_files.read_corpus(spark, str(bad)).collect()


def test_evidence_is_written_once(spark, tmp_path):
    path = str(tmp_path / "evidence")
    corpus_files.write_once(spark.range(1), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        corpus_files.write_once(spark.range(2), path)
    corpus_files.write_once(spark.range(3), path, force=True)
    assert spark.read.parquet(path).count() == 3


def test_taxonomy(spark):
    row = spark.range(1).select(
        rank_of(F.lit("O(n log n)"), TIME_CLASSES).alias("rank"),
        ordinal_distance(F.lit("O(1)"), F.lit("O(2^n)"), TIME_CLASSES).alias("far"),
        rounded_class(F.lit("O(n^2 log n)")).alias("up"),
        rounded_class(F.lit("O(n!)")).alias("top"),
    ).first()
    assert tuple(row) == (3, 6, "O(n^3)", "O(2^n)")


def test_case_violations(spark):
    sources = {lang: "code" for lang in cases.CORE_LANGUAGES}
    good = ("ok_case", "t", "g", ["x"], "O(n)", "O(1)", "O(n)", "O(1)", "r", sources, None)
    short = ("Bad", "t", "g", None, "O(x)", "O(1)", "n", "O(1)", "r", {"python": " "},
             {"go": {"time_class": "O(?)"}})
    rows = spark.createDataFrame([good, short, good], cases.CASE_SCHEMA)
    found = {(r.id, r.rule) for r in cases.violations(rows).collect()}
    assert found == {
        ("ok_case", "duplicate_id"), ("Bad", "bad_id"), ("Bad", "bad_class"),
        ("Bad", "bad_expression"), ("Bad", "missing_language"), ("Bad", "empty_source"),
        ("Bad", "stray_override"), ("Bad", "bad_override_class"), ("Bad", "unexplained_override"),
    }


def test_counted_selection_equals_a_sort(spark):
    import random

    from rankwell.functions.skew import keep_lowest_counted

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([rnd.randrange(5000), 7, 8]), i) for i in range(3000)]
    rows += [("few", 1, -1), ("few", 5000, -2)]
    table = spark.createDataFrame(rows, "g string, n long, id long")
    for limit in (1, 40, 500, 2500):
        want = {
            r for g in ("a", "b", "few", None) for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])[:limit]
        }
        got = keep_lowest_counted(table, ["g"], F.col("n"), [F.col("id")], limit, width=64)
        assert {tuple(r) for r in got.collect()} == want and got.columns == table.columns


def test_build_reads_the_texts_twice(spark, tmp_path):
    rows = [record(i, problem=f"p{i % 7}", code=f"c{i % 90}", signature=str(i % 11), time="O(n)" if i % 3 else None)
            for i in range(200)]
    frame(spark, rows).write.parquet(str(tmp_path / "records"))
    records = spark.read.parquet(str(tmp_path / "records"))
    built = build_corpus(records, dedupe_structure=True, max_per_problem=12, max_per_class=50)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    # the other read made the table of decisions, which holds no text
    tables = [line for line in plan.splitlines() if "Relation [" in line]
    assert sum("code#" in line for line in tables) == 1
    kept = built.collect()
    want = curate.exact_dedupe(records)
    want = curate.structure_dedupe(want)
    want = curate.cap_per_problem(want, 12)
    want = {r.input_pos for r in curate.keep_lowest(want, ["time_class"], curate.hash_order(), 50).collect()}
    assert {r.input_pos for r in kept} == want
