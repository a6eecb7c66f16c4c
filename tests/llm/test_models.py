"""Toxicity and language ID: held-out accuracy and defined odd cases."""

import math
import random
import re
import time
import zlib

import numpy as np

from rankwell.llm import langid, toxicity

RND = random.Random(9)
SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or".split(),
    "de": "sch ung ein ich ber ver keit heit zu lich der die und".split(),
    "fr": "eau ou oi eux tion ment que les ère aux une dans".split(),
    "es": "ción ado que los ez ñar osa llo mente ando una por".split(),
}


def sentence(lang, n=9):
    words = ["".join(RND.choice(SYLLABLES[lang]) for _ in range(RND.randrange(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def text(lang, sentences=6):
    return " ".join(sentence(lang) for _ in range(sentences))


def test_noisy_or():
    z = np.array([-1.0, 0.5, 2.0])
    p = toxicity.sigmoid(z)
    got = toxicity.noisy_or(z, np.array([0, 2, 2, 3]))
    assert np.allclose(got, [1 - (1 - p[0]) * (1 - p[1]), 0.0, p[2]])


def plain_score(text, model):
    """1 - prod(1 - p) over the sentences, word by word."""
    clean, z, words = 1.0, model.bias, 0
    for token in [*re.findall(r"[^\s]+|\n", text or ""), None]:
        if token is not None:
            z += sum(float(model.weights[c]) for c in toxicity.token_columns(token))
            words += 1
        if words and (token is None or token[-1] in ".!?\n…。！？"):
            clean *= 1 - 1 / (1 + math.exp(-z))
            z, words = model.bias, 0
    return 1 - clean


def test_query_equals_plain_loops_on_the_whole_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.toxicity_model(toxicity.labelled_sample(docs, labels))
    assert model.weights.any()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.toxic_documents(docs, labels).collect():
        want = plain_score(texts[r["doc_id"]], model)
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def plain_loss(bags, w, bias):
    at = doc = sentence = 0
    total = 0.0
    for y, plain, n in zip(bags.labels, bags.plain, bags.sentences):
        clean = (1 / (1 + math.exp(bias))) ** plain
        for size in bags.sizes[sentence : sentence + n]:
            clean *= 1 / (1 + math.exp(bias + sum(w[c] for c in bags.columns[at : at + size])))
            at += size
        sentence += n
        total -= math.log(max(1e-12, 1 - clean if y else clean))
        doc += 1
    return total / doc


def test_fit_follows_the_loss():
    rnd = np.random.default_rng(1)
    sentences = rnd.integers(0, 4, 60)
    sizes = rnd.integers(1, 4, sentences.sum())
    columns = rnd.integers(0, 5, sizes.sum())
    labels = (rnd.random(60) < 0.4).astype(float)
    bags = toxicity.Bags(labels, rnd.integers(0, 5, 60), sentences, sizes, columns)
    start = np.zeros(5)
    w, bias = toxicity.fit_noisy_or(bags, start, rounds=600, decay=0.0)
    least = plain_loss(bags, w, bias)
    assert least < plain_loss(bags, start, -2.0)
    for k in range(6):  # no step in any direction does better
        for h in (-0.05, 0.05):
            moved = w + h * (np.arange(5) == k)
            assert plain_loss(bags, moved, bias + h * (k == 5)) >= least - 1e-6


def test_a_long_run_of_punctuation_takes_linear_time():
    begin = time.process_time()
    assert toxicity.stripped("a" + "-" * 1_000_000 + "b") == "a" + "-" * 1_000_000 + "b"
    assert toxicity.stripped("-" * 1_000_000) == "" and toxicity.stripped("-(é1_)!") == "é1_"
    toxicity.sentence_columns("a" + "-" * 1_000_000 + "b. c")
    assert time.process_time() - begin < 5


def toxic_rows(n):
    rows = []
    for i in range(n):
        bad = i % 6 == 0
        parts = [sentence("en") for _ in range(RND.randrange(1, 12))]
        if bad:
            at = RND.randrange(len(parts))
            parts[at] = parts[at][:-1] + f" you {RND.choice(['zapfool', 'gritworm', 'mudlark'])} now."
        rows.append((i, " ".join(parts), int(bad)))
    return rows


def test_toxicity_is_learned_from_documents_and_located(spark, make_docs):
    rows = toxic_rows(1500)
    docs = make_docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame(
        [(i, y, 0) for i, _, y in rows] + [(0, None, 0), (None, 1, 0)], "doc_id bigint, toxic int, quality int")
    got = toxicity.toxic_documents(docs, labels).collect()
    truth = {i: (t, y) for i, t, y in rows}
    held = [r for r in got if r["held_out"]]
    assert 400 < len(held) < 600
    assert sum(r["predicted"] == truth[r["doc_id"]][1] for r in held) >= 0.97 * len(held)
    for r in held:
        body, y = truth[r["doc_id"]]
        if y and r["predicted"]:
            found = [body[s["start"] : s["end"]] for s in r["spans"]]
            assert any(w in f for f in found for w in ("zapfool", "gritworm", "mudlark"))
            assert len(found) < 4
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    clean = [i for i, _, y in rows if not y]
    assert sum(i in left for i in clean) >= 0.99 * len(clean)


def test_words_of_few_toxic_documents_are_learned(spark, make_docs):
    rnd = random.Random(4)
    rare = ["".join(rnd.choice("bcdfgklmnprstvz") for _ in range(9)) for _ in range(300)]
    rows = [(i, f"{sentence('en')} You {rare[i // 6 % 300]}.", 1) if i % 6 == 0
            else (i, sentence("en"), 0) for i in range(11_700)]
    docs = make_docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert toxicity.labelled_sample(docs, labels).count() > 7_500
    truth = {i for i, _, y in rows if y}
    held = [r for r in toxicity.toxic_documents(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] for r in held) >= 0.8 * len(held)


def test_toxicity_on_odd_rows_and_without_labels(spark, make_docs, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.toxic_documents(make_docs(odd_docs), none).collect()
    assert len(got) == len(odd_docs)
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == 0 for r in got)
    assert {r["doc_id"]: r["score"] for r in got}[1] == 0.0
    assert toxicity.toxic_documents(make_docs([]), none).collect() == []


def test_languages_are_told_apart(spark):
    rows = [(i, text(g, RND.randrange(1, 8)), g, 1) for i, g in enumerate(list(SYLLABLES) * 150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int")
    got = langid.identified_documents(docs).collect()
    truth = {i: g for i, _, g, _ in rows}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0.0 <= r["score"] <= 1.0 for r in got)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * len(rows)


def test_language_on_odd_rows(spark, make_docs, odd_docs):
    got = {r["doc_id"]: r for r in langid.identified_documents(make_docs(odd_docs)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und"
    assert got[4]["lang_pred"] == "en"
    assert langid.identified_documents(make_docs([])).collect() == []
    none = make_docs(odd_docs).withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identified_documents(none).collect()} == {"und"}
    kept = langid.keep_identified(none).collect()  # nothing is known of any language
    assert {r["doc_id"] for r in kept} == {i for i, t in odd_docs if t and any(map(str.isalpha, t))}


def test_a_family_of_three_votes():
    rows = [(text(g, 4), g) for g in ("en", "de") * 40]
    rows += [(t.replace("sch", "sj").replace("ein", "een"), "nl") for t, g in rows if g == "de"]
    model = langid.fit_languages([t for t, _ in rows], [g for _, g in rows])
    assert model.families == ("germanic",) and len(model.pairs) == 3
    assert langid.predict(model, text("en", 4))[0] == "en"


def test_language_fit_keeps_texts_off_the_driver(spark, monkeypatch):
    rows = [(i, text(lang, 2), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = langid.labelled_sample(docs)
    chosen = sorted((r["doc_id"], r["text"], r["lang"]) for r in sample.collect())
    want = langid.fit_languages([t for _, t, _ in chosen], [g for _, _, g in chosen])
    fits = []
    monkeypatch.setattr(langid, "fit_languages", lambda *a: fits.append(a) or want)
    got = langid.language_model(sample)
    # the fit ran in a task, not here
    assert not fits and got.families == want.families and got.pairs == want.pairs
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.bias, want.bias)
    assert langid.identified_documents(docs).count() == 80 and not fits
