"""Byte-level BPE against tiktoken, packing against its contract."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from rankwell.llm.bpe import Encoder, decode_ids, encode_texts, read_ranks, round_trip_digests
from rankwell.llm.packing import pack_documents, plan_packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def strings():
    rnd = random.Random(2)
    alphabet = "ab 1\n\t\r'sdé\x1c\x85\xa0　​ 日本ñ.,!"
    yield from ("", " ", "\n\n x", "don't 'll'VE", "<|endoftext|>", "a" * 3000, "ab" * 700 + "c", " " * 900 + "x")
    for _ in range(400):
        yield "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
    for size in (300, 500, 900):
        yield "".join(rnd.choice("etaoinshrdlu") for _ in range(size))


def test_encoding_is_that_of_the_library(reference):
    texts = [None, *strings()]
    got = Encoder(RANKS, PATTERN).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text or ""), repr(text)


def test_round_trip_in_spark(make_docs, odd_docs, reference):
    docs = make_docs(odd_docs)
    encoded = encode_texts(docs, RANKS, PATTERN)
    rows = Counter((r["doc_id"], bytes(r["bytes"])) for r in decode_ids(encoded, RANKS, PATTERN).collect())
    assert rows == Counter((i, (t or "").encode()) for i, t in odd_docs)
    sizes = Counter((r["doc_id"], r["n_tokens"]) for r in round_trip_digests(docs, RANKS, PATTERN).collect())
    assert sizes == Counter((i, len(reference.encode_ordinary(t or ""))) for i, t in odd_docs)
    assert round_trip_digests(make_docs([]), RANKS, PATTERN).collect() == []


def test_plan_places_every_piece_once():
    rnd = random.Random(4)
    for trial in range(30):
        capacity = rnd.choice((8, 50, 300))
        counts = {k: rnd.randrange(0, 40) for k in range(1, capacity + 1) if rnd.random() < 0.4}
        runs, sequences = plan_packing(counts, capacity)
        ranks, used = {}, {}
        for length, first, last, sequence, offset in runs:
            ranks.setdefault(length, []).extend(range(first, last + 1))
            for i in range(last - first + 1):
                used.setdefault(sequence + i, []).append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items() if n}
        assert len(used) == sequences
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(k * n for k, n in counts.items())
        assert sequences <= total / capacity * 1.3 + 2, trial


def test_exact_complements_fill_sequences():
    assert plan_packing({6: 2, 4: 2}, 10)[1] == 2
    assert plan_packing({5: 4}, 10)[1] == 2
    assert plan_packing({7: 3, 2: 3, 1: 3}, 10)[1] == 3
    assert plan_packing({4: 1, 3: 1, 2: 1, 1: 1}, 10)[1] == 1
    assert plan_packing({}, 10) == ([], 0)


def test_packing_in_spark(make_docs, odd_docs):
    capacity = 64
    got = pack_documents(make_docs(odd_docs), JSON, capacity=capacity).collect()
    tokenizer = Tokenizer.from_file(JSON)
    want = Counter()
    for i, t in odd_docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        stop, start, k = (len(ids) - 1) % capacity + 1, 0, 0
        while start < len(ids):
            want[i, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start, stop, k = stop, stop + capacity, k + 1
    assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= sum(r["length"] for r in got) / capacity * 1.1 + 2
    assert pack_documents(make_docs([]), JSON).collect() == []


def test_long_unbroken_runs_are_exact_and_near_linear(reference):
    import time

    rnd = random.Random(8)
    runs = ["".join(rnd.choice("etaoinshrdlu") for _ in range(n)) for n in (600, 5_000, 40_000)]
    runs += ["ab" * 20_000, "a" * 30_001, "é" * 9_000, "-" * 20_000, "日本" * 3_000]
    encoder = Encoder(RANKS, PATTERN)
    for text in runs:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
    begin = time.process_time()
    encoder.encode(["".join(rnd.choice("etaoinshrdlu") for _ in range(1_000_000)), "-" * 1_000_000])
    assert time.process_time() - begin < 60


def test_digests_are_those_of_the_library(spark, reference):
    import hashlib

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in round_trip_digests(rows, RANKS, PATTERN).collect():
        ids = np.array(reference.encode_ordinary(texts[r["doc_id"]])).astype("<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
