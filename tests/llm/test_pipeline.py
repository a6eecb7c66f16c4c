"""The pipeline on the smallest tables, and its stages on odd rows."""

from pathlib import Path

import pytest

import corpus_pipeline
from rankwell.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def test_queries_and_stages_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "language_id", "line_dedup", "ngram_join", "best_fit_packing"]


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
def test_stages_keep_columns_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    twice = docs.union(docs.limit(20)).union(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, twice, str(DATA))
        assert out.dtypes == docs.dtypes
        twice = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(twice.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 50
    ids = [r["doc_id"] for r in twice.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    packed = corpus_pipeline.STAGES[-1][1](spark, twice, str(DATA))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(ids)


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
def test_stages_on_an_empty_table_and_with_clashing_names(spark):
    schema = "doc_id bigint, text string, `line report` int, `component of id` string, `component key` string, lang string, y int"
    empty = spark.createDataFrame([], schema)
    said = "The cat sat on the mat and looked at the dog for a long time."
    rows = [(1, said, 1, "a", "b", "en", 2), (2, said, 1, "a", "b", "en", 2), (3, said + " Yes.", 1, "a", "b", "en", 2),
            (4, None, 1, "a", "b", None, 2), (5, "", 1, "a", "b", "en", 2), (6, said + "x" * 50_000, 1, "a", "b", "en", 2)]
    some = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, empty, str(DATA))
        assert nothing.collect() == [], name
        out = stage(spark, some, str(DATA))
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, 5, 6}
            continue
        assert out.dtypes == some.dtypes and nothing.dtypes == some.dtypes
        ids = {r["doc_id"] for r in out.collect()}
        assert ids == {
            "toxicity": {1, 2, 3, 4, 5, 6}, "language_id": ids, "line_dedup": {1, 4, 5}, "ngram_join": ids,  # the lines of 3 and 6 are near the first
        }[name]
        if name == "ngram_join":
            assert 1 in ids and 2 not in ids and {4, 5} <= ids


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
def test_run(spark):
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 2048


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_oracle(spark, name):
    import duckdb

    frame = QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    ours = sorted(repr([r[c] for c in columns]) for r in frame.collect())
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    assert ours == sorted(repr([row[i] for i in order]) for row in result.fetchall())
