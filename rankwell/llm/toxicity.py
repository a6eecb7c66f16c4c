"""Toxicity by multiple-instance learning.

Only documents have labels.  A sentence gets a probability from its words, and a
document is toxic if any sentence is: p = 1 - prod(1 - p_s), the noisy-or.  Its
gradient reaches the words through all sentences, so training finds out by itself
which sentences carry the label, and these can be pointed at afterwards.

The fit uses at most ``fit_rows`` labelled rows, those of the lowest hash of the
id; scoring reads every text whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import held_out, rows_passing, slim
from rankwell.session import discard, written

#: Labelled rows used for the fit at most.
FIT_ROWS = 8_000
#: Columns of hashed words.
DIMENSIONS = 1 << 18
#: Words that a task remembers before it starts anew.
MEMO = 300_000
PART = 1000
THRESHOLD = 0.7
#: Standard deviations above chance from which a column gets a weight.
TELLING = 5.0
_TOKEN = re.compile(r"[^\s]+|\n")
_LETTER = re.compile(r"\w")


def stripped(token: str) -> str:
    """Without punctuation at both ends; one scan from each."""
    first = _LETTER.search(token)
    if not first:
        return ""
    return token[first.start() : len(token) - _LETTER.search(token[::-1]).start()]


def token_columns(token: str) -> list[int]:
    """Hashed columns of a token's word and of its first three, four and five letters.

    In lower case, without punctuation at its ends.
    """
    word = stripped(token.lower())
    parts = dict.fromkeys((f"{word} ", *(word[:k] for k in (3, 4, 5) if len(word) >= k)))
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % DIMENSIONS for p in parts]


def ends_sentence(token: str) -> bool:
    return token[-1] in ".!?\n…。！？"


class Sentences:
    """Texts as arrays: a number per word, a start per sentence, a start per document."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.values = array("d")
        self.ends = array("b")

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words, start of each sentence, first sentence of each document."""
        if len(self.memo) > MEMO:
            self.clear()
        tokens = [_TOKEN.findall(t or "") for t in texts]
        for token in set().union(*tokens).difference(self.memo):
            self.memo[token] = len(self.ends)
            self.values.append(float(self.weights[token_columns(token)].sum()))
            self.ends.append(ends_sentence(token))
        ends = np.array(self.ends, bool)
        sizes = np.array([len(t) for t in tokens], np.int64)
        total = int(sizes.sum())
        at = np.fromiter((self.memo[w] for t in tokens for w in t), np.int64, total)
        starts_doc = np.concatenate([[0], np.cumsum(sizes)])
        new = np.zeros(total + 1, bool)
        new[1:] = ends[at] if total else []
        new[starts_doc] = True
        new[total] = False
        starts = np.flatnonzero(new)
        return at, starts, np.searchsorted(starts, starts_doc)


def sentence_logits(values: np.ndarray, bias: float, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values of a sentence's words, plus the bias."""
    if not len(starts):
        return np.zeros(0)
    return np.add.reduceat(values[words], starts) + bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def noisy_or(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) over the sentences of each document; 0 for none."""
    sums = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, logits))])
    return -np.expm1(-(sums[first[1:]] - sums[first[:-1]]))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def sentence_columns(text: str | None, memo: dict[str, list[int]] | None = None) -> tuple[array, array]:
    """Hashed columns of all words of a text in order, and how many each sentence has."""
    columns, lengths = array("i"), array("i")
    known = {} if memo is None else memo
    begin = 0
    for token in _TOKEN.findall(text or ""):
        found = known.get(token)
        if found is None:
            found = known[token] = token_columns(token)
        columns.extend(found)
        if ends_sentence(token):
            lengths.append(len(columns) - begin)
            begin = len(columns)
    if len(columns) > begin:
        lengths.append(len(columns) - begin)
    return columns, lengths


@dataclass(frozen=True)
class Bags:
    """Documents as bags of sentences, over the columns with a weight only."""

    labels: np.ndarray
    #: Sentences of each document without any such column.
    plain: np.ndarray
    #: Sentences with one, of each document, and columns of each such sentence.
    sentences: np.ndarray
    sizes: np.ndarray
    columns: np.ndarray


def used_columns(columns: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(sentences without a used column, used columns by place, how many each other sentence has)."""
    at = place[columns]
    hits = np.add.reduceat((at >= 0).astype(np.int64), np.cumsum(lengths) - lengths) if len(lengths) else lengths
    return int((hits == 0).sum()), at[at >= 0], hits[hits > 0].astype(np.int32)


def fit_noisy_or(
    bags: Bags, start: np.ndarray, rounds: int = 80, rate: float = 0.15, decay: float = 1e-5
) -> tuple[np.ndarray, float]:
    """Weights from ``start``, and the bias: full-batch Adam on the log loss of the noisy-or.

    An L2 ``decay`` holds the weights.  Without rows, or without columns, every score is
    near the share of toxic documents.
    """
    y, n = bags.labels, len(bags.labels)
    w = start.astype(np.float64)
    if not n:
        return w, -6.0
    every = bags.plain + bags.sentences
    bias = float(np.log(max(y.mean(), 1e-3) / max(1.0, every.mean()))) - 2.0
    of_doc = np.repeat(np.arange(n), bags.sentences)
    of_sentence = np.repeat(np.arange(len(bags.sizes)), bags.sizes)
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(of_sentence, w[bags.columns], len(bags.sizes)) + bias
        log_clean = np.bincount(of_doc, np.logaddexp(0, z), n) + bags.plain * np.logaddexp(0, bias)
        p = np.clip(-np.expm1(-log_clean), 1e-9, 1 - 1e-9)
        # d loss / dz: p_s for clean documents, -p_s (1 - p) / p for toxic ones
        pull = np.where(y > 0.5, -(1 - p) / p, 1.0) / n
        g_s = sigmoid(z) * pull[of_doc]
        grad = np.append(
            np.bincount(bags.columns, g_s[of_sentence], len(w)) + decay * w,
            g_s.sum() + sigmoid(np.array(bias)) * (pull * bags.plain).sum(),
        )
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        step = rate * (1 - t / (rounds + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, bias


def labelled_sample(
    docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled texts that are not held out, by the hash of the id.

    Ids with different labels count as toxic, and of different texts the least is taken.
    Only ids and labels are ordered; the texts of the chosen rows are joined to a table of
    at most ``rows`` ids.
    """
    known = slim(labels, doc_id=doc_id, y=label).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = slim(docs, id=doc_id, text=text)
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("y").cast("double").alias("y")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, list[int]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            if len(memo) > MEMO // 4:
                memo.clear()
            cut = [sentence_columns(t, memo) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"),
                 *(pa.array([np.frombuffer(c[i], np.int32) for c in cut], pa.list_(pa.int32())) for i in (0, 1))],
                names=["doc_id", "y", "columns", "lengths"],
            )


def _hits(used: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = np.full(DIMENSIONS, -1, np.int32)
    place[used] = np.arange(len(used))
    for batch in batches:
        columns = (np.array(c, np.int32) for c in batch.column("columns").to_pylist())
        lengths = (np.array(c, np.int64) for c in batch.column("lengths").to_pylist())
        found = [used_columns(c, n, place) for c, n in zip(columns, lengths, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([f[0] for f in found], pa.int64()),
             *(pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (1, 2))],
            names=["doc_id", "y", "plain", "hits", "sizes"],
        )


def toxicity_model(sample: DataFrame, least: int = 4) -> Model:
    """Fit on (doc_id, text, y), the rows of :func:`labelled_sample`.

    Weights are fitted to the columns that stand in at least ``least`` toxic documents and
    in more of them than chance explains; they start from their log-odds.  Texts are cut and
    counted in the executors; the driver gets those columns only, by sentence.
    """
    cut = written(
        sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("y").cast("double").alias("y"))
        .mapInArrow(_cut, "doc_id string, y double, columns array<int>, lengths array<int>"),
        "sentences",
    )
    n, toxic = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("y")), F.lit(0.0))).first()
    weights = np.zeros(DIMENSIONS, np.float32)
    share = toxic / n if n else 0.0
    counted = cut.select("y", F.explode(F.array_distinct("columns")).alias("column")).groupBy("column").agg(
        F.count(F.lit(1)).cast("double").alias("every"), F.count_if(F.col("y") > 0.5).cast("double").alias("bad")
    )
    expected = F.col("every") * share
    chance = F.sqrt(expected * (1 - share) + 1e-9)
    telling = counted.filter((F.col("bad") >= least) & ((F.col("bad") - expected) / chance >= TELLING))
    # columns are at most DIMENSIONS
    table = sorted((r["column"], r["every"], r["bad"]) for r in telling.collect())
    used, every, bad = (np.array(c) for c in zip(*table, strict=True)) if table else (np.zeros(0),) * 3
    used = used.astype(np.int64)
    odds = np.log((bad + 0.5) / (toxic + 1)) - np.log((every - bad + 0.5) / (n - toxic + 1))
    rows = cut.mapInArrow(
        partial(_hits, used), "doc_id string, y double, plain bigint, hits array<int>, sizes array<int>"
    ).toArrow().sort_by("doc_id")
    discard(cut)

    def flat(name: str) -> np.ndarray:
        return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    sentences = np.array([len(x) for x in rows.column("sizes").to_pylist()], np.int64)
    bags = Bags(rows.column("y").to_numpy(), rows.column("plain").to_numpy(), sentences, flat("sizes"), flat("hits"))
    fitted, bias = fit_noisy_or(bags, odds)
    weights[used] = fitted
    return Model(weights, bias)


_SCORED = "doc_id bigint, score double, spans array<struct<start:bigint,end:bigint,p:double>>"


def _spans(text: str, p: np.ndarray, least: float) -> list[dict]:
    """Character ranges of the sentences with probability ``least`` or more."""
    found: list[dict] = []
    k, start = 0, None
    last = 0
    for m in _TOKEN.finditer(text):
        start = m.start() if start is None else start
        last = m.end()
        if ends_sentence(m[0]):
            if p[k] >= least:
                found.append({"start": start, "end": last, "p": float(p[k])})
            k, start = k + 1, None
    if start is not None and p[k] >= least:
        found.append({"start": start, "end": last, "p": float(p[k])})
    return found


def _score(
    model: Model, spans: bool, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    cut = Sentences(model.weights)
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            texts = part.column("text").to_pylist()
            words, starts, first = cut(texts)
            logits = sentence_logits(np.array(cut.values), model.bias, words, starts)
            score = noisy_or(logits, first)
            where = [
                _spans(t, sigmoid(logits[first[i] : first[i + 1]]), 0.5)
                if spans and t and score[i] >= 0.5 else []
                for i, t in enumerate(texts)
            ]
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(np.clip(score, 0.0, 1.0), pa.float64()),
                    pa.array(where, pa.list_(kind)),
                ],
                names=["doc_id", "score", "spans"],
            )


def score_toxicity(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", spans: bool = True
) -> DataFrame:
    """(doc_id, score, spans) per input row; spans are the offending sentences.

    NULL, empty and blank texts score 0 and have no spans.  Rows do not depend on
    one another, so ties, repeated rows and NULL ids need no rule; an empty table
    gives an empty table; other columns are not read.
    """
    rows = slim(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(partial(_score, model, spans), _SCORED)


def toxic_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on labelled rows that are not held out, then score every row.

    doc_id, held_out, score, predicted, spans.  A NULL id counts as held out.
    """
    scored = score_toxicity(docs, toxicity_model(labelled_sample(docs, labels, fit_rows)))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans",
    )


class _Clean:
    """Whether texts are below the threshold; one memo per task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.cut: Sentences | None = None

    def __call__(self, texts: list[str | None]) -> list[bool]:
        self.cut = self.cut or Sentences(self.model.weights)
        words, starts, first = self.cut(texts)
        logits = sentence_logits(np.array(self.cut.values), self.model.bias, words, starts)
        return (noisy_or(logits, first) < THRESHOLD).tolist()


def drop_toxic(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Cases as in :func:`score_toxicity`: NULL and empty texts stay.
    """
    model = toxicity_model(labelled_sample(docs, labels, fit_rows, doc_id, text))
    return rows_passing(docs, _Clean(model), text)
