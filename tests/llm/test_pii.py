"""Personal data: fixed rules against plain patterns, votes against drawn truths, and the query."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from rankwell.llm.pii import (
    KINDS, LABELERS, candidates, fit_spans, fixed_rules, luhn, overlaps, personal_data, reliabilities, span_digests,
)

DATA = "/root/testdata/sf0.01"


def brute(text):
    """(start, end, kind number) by the plain patterns, without any care for time."""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((*m.span(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def test_fixed_rules_equal_the_patterns():
    rnd = random.Random(1)
    for alphabet in ("0123459a.@-+ ()x%", "01.", "a@.-", "0 -", "+1 ()."):
        for _ in range(6000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(45)))
            assert fixed_rules(text)[0] == brute(text), text


def test_luhn_by_hand():
    assert luhn("4539578763621486") and luhn("79927398713") and not luhn("79927398710")


def test_overlaps_equal_all_pairs():
    rnd = random.Random(2)
    ranges = [(3, 5), (5, 9), (12, 20), (30, 31)]
    for _ in range(500):
        a = rnd.randrange(35)
        b = a + rnd.randrange(1, 9)
        assert overlaps(ranges, a, b) == any(x < b and a < y for x, y in ranges)


@pytest.mark.parametrize("unit", ["a", "1", "a@", "+", "+1 ", "1 ", " at a dot ", "(at)", "a.", "a.@"])
def test_unbroken_runs_take_linear_time(unit):
    begin = time.process_time()
    candidates(unit * (600_000 // len(unit)))
    assert time.process_time() - begin < 10


def test_votes_of_drawn_truths_give_their_reliabilities():
    rnd = random.Random(3)
    right = (0.95, 0.9, 0.8, 0.7, 0.6)
    silent = (0.0, 0.1, 0.2, 0.6, 0.3)
    counts, truth = {}, {}
    for _ in range(40_000):
        true = rnd.random() < 0.3
        pattern = "".join(
            "-" if rnd.random() < s else "yn"[(rnd.random() < r) != true] for r, s in zip(right, silent, strict=True)
        )
        counts[pattern] = counts.get(pattern, 0) + 1
        truth.setdefault(pattern, []).append(true)
    trust = reliabilities(counts)
    assert abs(trust.share - 0.3) < 0.03
    for k in range(len(LABELERS)):
        yes, no, _ = trust.votes[1][k]
        assert abs(yes / (yes + no) - right[k]) < 0.04
    for pattern, seen in truth.items():
        if len(seen) > 400:
            assert abs(trust.likelihood(pattern) - sum(seen) / len(seen)) < 0.08


def test_nothing_to_learn_from():
    assert reliabilities({}).share == 0.5
    assert not fit_spans([]).any()


def card(rnd):
    while not luhn(number := "4" + "".join(rnd.choice("0123456789") for _ in range(15))):
        pass
    return number


def planted(rnd):
    """(text, what the method must add, what it must leave alone)."""
    rows = []
    for _ in range(300):
        rows += [
            (f"write to ann{rnd.randrange(99)}@mail.example.com soon", None, None),
            (f"call +1 (212) 555-{rnd.randrange(1000, 9999)} now", None, None),
            (f"her card is {card(rnd)} she said", None, None),
            (f"the host {rnd.randrange(1, 223)}.4.{rnd.randrange(255)}.9 answers", None, None),
        ]
        number = card(rnd)
        wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
        rows.append((f"order no {wrong} was sent", None, wrong))
    for _ in range(40):
        first, second = card(rnd), card(rnd)
        rows.append((f"cards {first} {second} both", first, None))
        rows.append(("mail me: bob.ray [at] example [dot] com thanks", "bob.ray [at] example [dot] com", None))
        rows.append((f"server 10[.]2[.]3[.]{rnd.randrange(255)} is mine", "10[.]2[.]3", None))
        phone = f"212-555-{rnd.randrange(1000, 9999)}"
        rows.append((f"please call {phone} today", phone, None))
        rows.append(("we met at home and at work", None, "home"))
    return [(i, *r) for i, r in enumerate(rows)]


def test_method_adds_spans_and_leaves_lookalikes(spark, make_docs):
    rows = planted(random.Random(5))
    found = {r["doc_id"]: r for r in personal_data(make_docs([r[:2] for r in rows])).collect()}
    added = missed = wrong = 0
    for i, text, want, leave in rows:
        spans = [(s["start"], s["end"], s["kind"]) for s in found[i]["spans"]]
        base = [(s["start"], s["end"], s["kind"]) for s in found[i]["base"]]
        assert base == brute(text) and set(base) <= set(spans)
        texts = [text[a:b] for a, b, _ in spans]
        if want:
            hit = any(want in t for t in texts)
            added, missed = added + hit, missed + (not hit)
        if leave:
            wrong += any(leave in t for t in texts)
    assert added >= 0.9 * (added + missed) and wrong == 0


def test_query_equals_brute_force_on_the_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in span_digests(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        spans = brute(text or "")
        row = got[doc_id]
        assert [row[f"n_{k}"] for k in KINDS] == [sum(s[2] == n for s in spans) for n in range(4)]
        assert row["base_sha256"] == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert {f"{KINDS[k]}:{a}:{b}" for a, b, k in spans} <= set(row["spans"].split(","))


def test_odd_rows(spark, make_docs, odd_docs):
    long = "wort kaum " * 30_000 + " a@b.de " + "9" * 200_000
    rows = [*odd_docs, (90, long), (91, "é 1.2.3.4 ß@x.de 日本 a@b.co"), (91, "é 1.2.3.4 ß@x.de 日本 a@b.co")]
    got = sorted((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["base_sha256"]) for r in span_digests(make_docs(rows)).collect())
    want = []
    for i, text in rows:
        spans = brute((text or "")[:-199_000] if i == 90 else text or "")
        want.append((i or -1, sum(s[2] == 0 for s in spans), sum(s[2] == 1 for s in spans),
                     hashlib.sha256(listed(spans).encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(spark, make_docs):
    assert span_digests(make_docs([])).collect() == []
