"""Line dedup, the n-gram join and exact dedup against brute force."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np

from rankwell.llm import ngram_join
from rankwell.llm.components import components
from rankwell.llm.line_dedup import dedup_lines
from rankwell.llm.ngram_join import may_link, near_duplicates, sketch
from rankwell.llm.recipe_dedup import LONGEST, cut_points, exact_duplicates

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(words):
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similar(a, b):
    return bool(a) and 4 * len(a & b) >= 3 * len(a | b)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(SPLIT.findall((t or "").translate(ASCII)))
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and similar(sets[a], sets[b]):
                    label[a], changed = label[b], True
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 130)}}


def test_ngram_join_on_odd_rows(make_docs, odd_docs):
    got = near_duplicates(make_docs(odd_docs)).collect()
    assert len(got) == len(odd_docs)
    want = brute_components(odd_docs)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r


def test_ngram_join_on_chains_of_edits_and_common_passages(make_docs):
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    rows, doc = [], [f"a{i}" for i in range(120)]
    for i in range(60):  # each a few edits from the one before: linked in a chain
        doc = list(doc)
        doc[rnd.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(doc)))
    for i in range(100, 140):  # a passage that many share, in texts that differ
        own = [f"o{i}x{k}" for k in range(rnd.choice((4, 8, 12, 40)))]
        rows.append((i, " ".join(own[:3] + passage + own[3:])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == brute_components(rows)


def test_an_empty_table(make_docs):
    none = make_docs([])
    assert near_duplicates(none).collect() == []
    assert exact_duplicates(none).collect() == []
    assert dedup_lines(none).collect() == []


def brute_lines(rows):
    seen, out = [], []
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        kept = []
        for no, line in enumerate(t.split("\n")):
            s = shingles([w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w])
            if not any(at < (i, no) and similar(s, other) for at, other in seen):
                kept.append(line)
            if s:
                seen.append(((i, no), s))
        out.append((i, "\n".join(kept)))
    return out


def test_line_dedup_against_brute_force(make_docs):
    rnd = random.Random(3)
    pool = [[f"v{rnd.randrange(300)}" for _ in range(rnd.randrange(1, 40))] for _ in range(30)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(rnd.randrange(0, 8)):
            line = list(rnd.choice(pool))
            if rnd.random() < 0.5:
                line[rnd.randrange(len(line))] = f"z{rnd.randrange(5)}"
            lines.append(" ".join(line) if rnd.random() < 0.9 else "")
        rows.append((i, "\n".join(lines)))
    got = dedup_lines(make_docs(rows), report="kept").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute_lines(rows)
    assert all(r["key"] == 8 and r["kept"]["n_lines"] >= 1 for r in got)


def test_line_dedup_on_odd_rows(make_docs, odd_docs):
    rows = [r for r in odd_docs if r[0] != 8]
    got = dedup_lines(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] and r["text"] is not None) == brute_lines(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["text"] is None and by_id[None]["text"] == "a b c"
    twice = dedup_lines(make_docs([(8, "one two three"), (8, "one two three")])).collect()
    assert [r["text"] for r in twice] == ["one two three"] * 2


def test_exact_dedup_on_odd_rows(make_docs, odd_docs):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in odd_docs:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i))
    for widths in ((8,), (1, 2, 32)):  # one byte collides, so the check must move on
        got = exact_duplicates(make_docs(odd_docs), widths=widths).collect()
        assert len(got) == len(odd_docs)
        texts = dict(odd_docs)
        for r in got:
            group = groups[normal(texts[r["doc_id"]])]
            assert r["keep_id"] == min(group)[2] and r["group_size"] == len(group)
            assert r["kept"] == (r["doc_id"] == r["keep_id"])
            assert r["text_sha256"] == hashlib.sha256(normal(texts[r["doc_id"]]).encode()).hexdigest()


def test_chunks_follow_the_content():
    rnd = random.Random(1)
    body = bytes(rnd.randrange(256) for _ in range(200_000))
    ends = cut_points(body)
    assert ends == sorted(set(ends)) and ends[-1] == len(body)
    shifted = cut_points(b"new start" + body)
    assert len({e + 9 for e in ends} & set(shifted)) > 0.9 * len(ends)
    flat = cut_points(b"a" * (3 * LONGEST + 5))
    assert max(b - a for a, b in zip([0, *flat], flat, strict=False)) <= LONGEST
    assert cut_points(b"") == []


def test_line_dedup_leaves_only_its_result_on_disk(spark, make_docs, monkeypatch):
    from rankwell.llm import line_dedup

    made, gone = [], []
    write, drop = line_dedup.written, line_dedup.discard
    monkeypatch.setattr(line_dedup, "written", lambda frame, name: made.append(name) or write(frame, name))
    monkeypatch.setattr(line_dedup, "discard", lambda frame: gone.append(frame) or drop(frame))
    rows = [(i, f"a b c d e f g h {i % 3}\nq r s t u v w x {i} y") for i in range(12)]
    got = dedup_lines(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute_lines(rows)
    assert len(made) - len(gone) == 1 and made[-1] == "kept"
    assert made.index("keyed") < made.index("sets") < made.index("pairs") < made.index("later")


def test_sketches_never_rule_out_a_link():
    rnd = np.random.default_rng(3)
    for n in (1, 4, 31, 33, 64, 700, 5000):
        for share in (0.0, 0.5, 0.74, 0.75, 0.8, 1.0):
            x = np.unique(rnd.integers(0, 1 << 64, n, np.uint64, endpoint=False))
            kept = x[: int(np.ceil(share * n))]
            more = np.unique(rnd.integers(0, 1 << 64, max(0, int(n * 1.1) - len(kept)), np.uint64))
            for y in (kept, np.union1d(kept, more)):
                if len(y) and 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y)):
                    assert may_link(sketch(x), sketch(y)) and may_link(sketch(y), sketch(x))
    far = [np.unique(rnd.integers(0, 1 << 64, 700, np.uint64)) for _ in range(2)]
    assert not may_link(sketch(far[0]), sketch(far[1]))
    assert may_link(None, sketch(far[0]))


def test_ngram_join_moves_whole_sets_of_near_pairs_only(make_docs, monkeypatch):
    rnd = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(100))) for i in range(30)]
    rows += [(i + 100, rows[i][1] + " one more") for i in range(3)]
    moved = []
    real = ngram_join.written_bucketed

    def counted(frame, name, *keys):
        table = real(frame, name, *keys)
        moved.append((name, table[0].count()))
        return table

    monkeypatch.setattr(ngram_join, "written_bucketed", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(rows)).collect()}
    assert got == {i: i % 100 for i, _ in rows}
    # six documents are links; the others share a passage with all
    assert max(n for name, n in moved if name == "sets") == 6


def test_line_dedup_shingles_again_only_lines_that_can_match(make_docs, monkeypatch):
    from rankwell.llm import line_dedup

    again = []
    write = line_dedup.written

    def counted(frame, name):
        table = write(frame, name)
        if name == "tokens":
            again.append(table.count())
        return table

    monkeypatch.setattr(line_dedup, "written", counted)
    rnd = random.Random(5)
    own = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(36))
    # every two lines of a group share one passage, too short for a link
    rows = [(i, f"p{i % 20} q r s t{i % 20} {own()}") for i in range(40)]
    rows += [(i + 100, rows[i][1] + " more") for i in range(3)]
    got = dedup_lines(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute_lines(rows)
    assert sum(r["text"] == "" for r in got) == 3
    assert sum(again) <= 12


def test_line_dedup_on_odd_white_space_and_letters(make_docs):
    words = [f"É{i} Σ" for i in range(30)]
    rows = [(1, " ".join(words)), (2, "\t\v" + "\f".join(words) + "\r"), (3, "  ".join(words).lower()),
            (4, "\t \r\n\v\nx\ty"), (5, "X Y\n ")]
    got = dedup_lines(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute_lines(rows)


def test_line_dedup_bounds_the_disk_of_pairs_and_shingles(make_docs, monkeypatch):
    from rankwell.llm import line_dedup

    made, gone, shingles_left = [], [], []
    write, drop = line_dedup.written, line_dedup.discard

    def counted(frame, name):
        made.append((name, table := write(frame, name)))
        if name == "keyed":
            lines = next(t for n, t in made if n == "lines").inputFiles()
            shingles_left.append(sum(Path(f.removeprefix("file:")).exists() for f in lines))
        return table

    monkeypatch.setattr(line_dedup, "written", counted)
    monkeypatch.setattr(line_dedup, "discard", lambda frame: gone.append(frame) or drop(frame))
    rnd = random.Random(4)
    pool = [" ".join(f"p{i}w{j}" for j in range(8)) for i in range(6)]
    # lines of passages in any order: most share tokens with many others, and few are similar
    rows = [(i, " ".join(rnd.sample(pool, 4))) for i in range(80)]
    rows += [(i + 100, rows[i][1] + " more") for i in range(5)]
    got = dedup_lines(make_docs(rows).repartition(8)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute_lines(rows)
    names = [name for name, _ in made]
    assert names.count("pairs") > 1 and names.count("later") > 1 and names.count("index") > 1
    assert len(made) - len(gone) == 1
    # a part of the shingles is gone when the next prefixes are written
    assert len(shingles_left) > 2 and sorted(set(shingles_left), reverse=True) == shingles_left
