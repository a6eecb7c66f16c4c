"""Language identification in two steps: the family, then the language within it.

Features are shares of hashed character n-grams.  A softmax over families comes
first; inside a family one-versus-one linear support vector machines separate the
languages, which share most of their n-grams and need weights of their own.

The fit uses at most ``fit_rows`` labelled rows, evenly over the languages, by the
hash of the id; prediction reads every text whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import held_out, rows_passing, slim

#: Labelled rows used for the fit at most.
FIT_ROWS = 4_000
BITS = 13
COLUMNS = 1 << BITS
UNDETERMINED = "und"
#: Rows below are rejected by :func:`keep_identified`.
LEAST_SCORE = 0.35
# Language families by ISO 639-1 code; other codes are families of their own.
FAMILIES = {
    "romance": "ca es fr gl it oc pt ro",
    "germanic": "af da de en is lb nl no nb nn sv",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "sinitic": "zh",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: ASCII other than letters is a blank.
_BLANKS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], lang)


def ngram_columns(text: str) -> np.ndarray:
    """Hashed columns of the byte 1-, 2- and 3-grams of the letters, in lower case."""
    body = f" {text.lower()} ".encode("utf-8", "surrogatepass").translate(_BLANKS)
    b = np.frombuffer(body, np.uint8).astype(np.uint32)
    two = b[:-1] | (b[1:] << np.uint32(8))
    three = two[:-1] | (b[2:] << np.uint32(16))
    grams = np.concatenate([b, two | np.uint32(1 << 24), three | np.uint32(2 << 24)])
    return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def _shares(text: str) -> np.ndarray:
    columns = ngram_columns(text)
    return np.bincount(columns, minlength=COLUMNS).astype(np.float32) / len(columns)


def _largest_norm(x: np.ndarray) -> float:
    return float(np.einsum("ij,ij->i", x, x).max())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((classes, x.shape[1]), np.float32), np.zeros(classes, np.float32)
    if classes < 2:
        return w, b
    target = np.eye(classes, dtype=np.float32)[y]
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    rate = 4.0 / _largest_norm(x)
    for _ in range(rounds):
        off = (_softmax(x @ w.T + b) - target) / len(x)
        speed_w = 0.9 * speed_w - rate * (off.T @ x + 1e-4 * w)
        speed_b = 0.9 * speed_b - rate * off.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    return w, b


def _fit_svm(x: np.ndarray, sign: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, full batch with momentum."""
    w, b, speed, speed_b = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    rate = 0.5 / _largest_norm(x)
    for _ in range(rounds):
        short = np.maximum(0, 1 - sign * (x @ w + b)) * sign / len(x)
        speed = 0.9 * speed + rate * (2 * (short @ x) - 1e-4 * w)
        speed_b = 0.9 * speed_b + rate * 2 * short.sum()
        w, b = w + speed, b + speed_b
    return w, float(b)


@dataclass(frozen=True)
class Model:
    """Rows of ``weights``: one per family, then one per pair of languages of a family."""

    families: tuple[str, ...]
    langs: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[int, int, int], ...]
    weights: np.ndarray
    bias: np.ndarray


def fit_languages(texts: Sequence[str | None], langs: Sequence[str]) -> Model:
    """Fit both steps.  Rows whose text has no letters are left out."""
    rows = [(t, g) for t, g in zip(texts, langs, strict=True) if t and has_letters(t)]
    families = tuple(sorted({family_of(g) for _, g in rows}))
    members = tuple(tuple(sorted({g for _, g in rows if family_of(g) == f})) for f in families)
    pairs = tuple((f, a, b) for f, gs in enumerate(members) for a, b in combinations(range(len(gs)), 2))
    if not rows:
        return Model((), (), (), np.zeros((0, COLUMNS), np.float32), np.zeros(0))
    x = np.empty((len(rows), COLUMNS), np.float32)
    for i, (t, _) in enumerate(rows):
        x[i] = _shares(t)
    mean = x.mean(axis=0)
    # rare n-grams weigh as much as common ones: columns scaled by their mean share
    scale = (1 / np.sqrt(mean + 1e-5)).astype(np.float32)
    x *= scale
    lang = np.array([g for _, g in rows])
    fam = np.array([families.index(family_of(g)) for g in lang])
    w, b = _fit_softmax(x, fam, len(families))
    weights, bias = [*w], [*b]
    for f, a, c in pairs:
        one, other = members[f][a], members[f][c]
        mine = (lang == one) | (lang == other)
        v, d = _fit_svm(x[mine], np.where(lang[mine] == one, 1.0, -1.0).astype(np.float32))
        weights.append(v)
        bias.append(d)
    return Model(families, members, pairs, np.stack(weights) * scale, np.array(bias, np.float64))


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """Language and score: the share of the family times that of the language in it."""
    if not text or not model.families or not has_letters(text):
        return UNDETERMINED, 0.0
    columns = ngram_columns(text)
    z = model.bias.copy()
    for at in range(0, len(columns), 1 << 20):
        z += model.weights[:, columns[at : at + (1 << 20)]].sum(axis=1) / len(columns)
    n = len(model.families)
    shares = _softmax(z[None, :n])[0]
    f = int(shares.argmax())
    langs = model.langs[f]
    votes, margins = np.zeros(len(langs)), np.zeros(len(langs))
    least = np.full(len(langs), np.inf)
    for (g, a, b), m in zip(model.pairs, z[n:], strict=True):
        if g != f:
            continue
        votes[a if m >= 0 else b] += 1
        margins[a] += m
        margins[b] -= m
        least[a], least[b] = min(least[a], m), min(least[b], -m)
    best = max(range(len(langs)), key=lambda i: (votes[i], margins[i], -i))
    inside = 1.0 if len(langs) == 1 else 1 / (1 + np.exp(-3.0 * least[best]))
    return langs[best], float(min(1.0, shares[f] * inside))


def labelled_sample(
    docs: DataFrame, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(doc_id, text, lang): at most ``rows`` labelled texts that are not held out, evenly over languages.

    Only ids are ordered, by their hash; texts are joined to the chosen ids.
    """
    known = slim(docs, doc_id=doc_id, lang=lang).filter("doc_id IS NOT NULL AND lang IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).withColumn(
        "u", F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    )
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = max(1, rows // max(1, counts.count()))
    # each language gives about its share, whatever its size; the order cuts the rest
    drawn = known.join(counts.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"))
    drawn = drawn.filter(F.col("u") * F.col("n") < share).orderBy("u", "doc_id").limit(rows)
    chosen = drawn.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    texts = slim(docs, id=doc_id, text=text)
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("lang").alias("lang")
    )


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, langs = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        langs += batch.column("lang").to_pylist()
    model = pickle.dumps(fit_languages(texts, langs))
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])


def language_model(sample: DataFrame) -> Model:
    """Fit on the rows of :func:`labelled_sample`, a bounded number, in one task.

    Neither the texts nor their features come to the driver, only the weights do.
    """
    ordered = sample.coalesce(1).sortWithinPartitions("doc_id")
    found = ordered.select("text", "lang").mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit_languages([], [])


def _predict(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [predict(model, t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([g for g, _ in found], pa.string()),
                pa.array([s for _, s in found], pa.float64()),
            ],
            names=["doc_id", "lang_pred", "score"],
        )


def predict_languages(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, lang_pred, score) per input row.

    NULL and empty texts and texts without letters are ``und`` with score 0, as all
    texts are when the model saw no labelled row.  Rows do not depend on one another,
    so ties, repeated rows and NULL ids need no rule; an empty table gives an empty
    table; other columns are not read.
    """
    rows = slim(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(partial(_predict, model), "doc_id bigint, lang_pred string, score double")


def identified_documents(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on labelled rows that are not held out, then predict every row.

    doc_id, held_out, lang_pred, score.  A NULL id counts as held out.
    """
    model = language_model(labelled_sample(docs, fit_rows))
    return predict_languages(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def _identified(model: Model, least: float, texts: list[str | None]) -> list[bool]:
    found = [predict(model, t) for t in texts]
    return [g != UNDETERMINED and s >= least for g, s in found]


def keep_identified(
    docs: DataFrame, fit_rows: int = FIT_ROWS, least: float = LEAST_SCORE,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more.

    With all their columns.  Rejected are texts that are NULL, empty or without
    letters, and those between languages.  Without labelled rows nothing is known of
    any language, and only texts without letters go.
    """
    model = language_model(labelled_sample(docs, fit_rows, doc_id, text, lang))
    if not model.families:
        return rows_passing(docs, _lettered, text)
    return rows_passing(docs, partial(_identified, model, least), text)


def _lettered(texts: list[str | None]) -> list[bool]:
    return [bool(t) and has_letters(t) for t in texts]
