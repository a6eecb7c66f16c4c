"""Personal data by weak supervision.

Fixed rules find e-mail addresses, IP addresses, card and phone numbers; what they find
stays.  Around them, looser rules propose candidates: addresses written out with "at" and
"dot", addresses and numbers in other spellings, and what has the form but fails the rule.

Five labelers vote on every candidate (yes, no, nothing): the strict rule, a checksum or
range, a gazetteer of endings, issuers and calling codes, cue words before it, and its
borders.  Only documents are given, no labels: expectation-maximisation estimates from the
counts of vote patterns over all documents how often each labeler is right, and so how
likely a candidate is personal data.  These likelihoods train the final classifier, a
logistic regression on form, borders, words around and votes, which decides on what the
fixed rules left out.

Scanning is linear in a text, also on unbroken runs: a rule is tried once per run.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import slim
from rankwell.session import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Candidates used to fit the final classifier at most; counts of votes cover all.
FIT_SPANS = 20_000
#: Columns of hashed features.
DIMENSIONS = 1 << 14
#: Likelihood from which a candidate is a span.
ACCEPT = 0.9
PART = 1000
YES, NO, NOTHING = "yn-"
LABELERS = ("rule", "check", "gazetteer", "context", "border")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# looser spellings; every part is bounded, so a try costs a bounded time
_AT_SIGN = re.compile(r"(?:\(at\)|\[at\]|\{at\}|\x20at\x20)")
_AT_BEFORE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?\Z")
_AT_AFTER = re.compile(
    r"\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}){1,4}"
)
_IP_LOOSE = re.compile(
    r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])"
)
_CARD_LOOSE = re.compile(
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7})(?![0-9])"
)
_PHONE_LOOSE = re.compile(
    r"(?<![0-9+])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20./-][0-9]{3}[\x20./-][0-9]{4}(?![0-9])"
)

# fixed values: common top-level domains
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev me tv cc co us uk de fr es it nl be at ch se no "
    "dk fi pl cz pt gr ie ru ua br ar mx ca au nz in cn jp kr za eu".split()
)
# fixed values: leading digits of card issuers with the lengths they use
ISSUERS = (
    (4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)),
    (300, 305, (14,)), (36, 36, (14, 16)), (38, 39, (14, 16)), (6011, 6011, (16, 19)), (644, 649, (16, 19)),
    (65, 65, (16, 19)), (3528, 3589, (16, 19)),
)
# fixed values: calling codes of one and two digits, and the first digits of those with three
CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 "
    "86 90 91 92 93 94 95 98".split()
)
LONG_CALLING_CODES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
# fixed values: words before personal data, and before what only looks like it, in four languages
CUES = (
    "email e-mail mail contact contacto kontakt courriel correo write schreiben",
    "ip host server address adresse dirección client login",
    "card visa mastercard amex karte kreditkarte carte tarjeta credit kredit",
    "phone tel telephone telefon téléphone teléfono call mobile handy fax whatsapp sms",
)
OTHERS = "version v release build section isbn issn order invoice token sha hash key id no nr art doi"
_CUES = [frozenset(words.split()) for words in CUES]
_OTHERS = frozenset(OTHERS.split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

Span = tuple[int, int, int]  # start, end, kind


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    """Whether the doubled-every-other digit sum is divisible by ten."""
    total = sum(map(int, digits[::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def small_part(part: str) -> bool:
    """A number of at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, one try per sign."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        begin = sign
        while begin > done and not _NOT_LOCAL.match(text, begin - 1):
            begin -= 1
        found = _DOMAIN.match(text, sign + 1) if begin < sign else None
        if found:
            done = found.end()
            yield begin, done
        sign = text.find("@", max(sign + 1, done))


def fixed_rules(text: str) -> tuple[list[Span], list[Span]]:
    """(spans, matches that fail their rule), each in order of start, then kind."""
    spans: list[Span] = [(a, b, EMAIL) for a, b in emails(text)]
    failed: list[Span] = []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            good = all(map(small_part, m[0].split(".")))
            (spans if good else failed).append((*m.span(), IP))
        for m in _CARD.finditer(text):
            digits = digits_of(m[0])
            good = 14 <= len(digits) <= 19 and luhn(digits)
            if good or 12 <= len(digits) <= 21:
                (spans if good else failed).append((*m.span(), CARD))
        for m in _PHONE.finditer(text):
            good = 10 <= len(digits_of(m[0])) <= 15
            (spans if good else failed).append((*m.span(), PHONE))
    return sorted(spans, key=lambda s: (s[0], s[2])), failed


def loose_spans(text: str) -> Iterator[Span]:
    """What other spellings propose."""
    if "at" in text:
        for m in _AT_SIGN.finditer(text):
            after = _AT_AFTER.match(text, m.end())
            before = _AT_BEFORE.search(text, max(0, m.start() - 65), m.start()) if after else None
            if before:
                yield before.start(), after.end(), EMAIL
    if _DIGIT.search(text):
        for kind, rule in ((IP, _IP_LOOSE), (CARD, _CARD_LOOSE), (PHONE, _PHONE_LOOSE)):
            for m in rule.finditer(text):
                yield *m.span(), kind


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The ranges that spans, in order of start, cover together."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def overlaps(ranges: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the disjoint ranges, in order, shares a place with [start, end)."""
    k = bisect_left(ranges, (end,))
    return k > 0 and ranges[k - 1][1] > start


def _check(kind: int, body: str, digits: str) -> str:
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]+", body.strip())[-1]
        return YES if last.isalpha() and 2 <= len(last) <= 24 else NO
    if kind == IP:
        return YES if all(map(small_part, _parts(body))) else NO
    if kind == CARD:
        return YES if 13 <= len(digits) <= 19 and luhn(digits) else NO
    return YES if 10 <= len(digits) <= 15 else NO


def _parts(body: str) -> list[str]:
    return re.findall("[0-9]+", body)


def _gazetteer(kind: int, body: str, digits: str) -> str:
    if kind == EMAIL:
        return YES if re.split(r"[^A-Za-z0-9-]+", body.strip())[-1].lower() in TOP_LEVEL else NO
    if kind == IP:
        first = int(_parts(body)[0][-4:])
        return YES if 1 <= first <= 223 else NO
    if kind == CARD:
        for low, high, lengths in ISSUERS:
            if len(digits) in lengths and low <= int(digits[: len(str(low))]) <= high:
                return YES
        return NO
    if body.startswith("+") or digits.startswith("00"):
        code = digits.removeprefix("00")
        known = code[:1] in CALLING_CODES or code[:2] in CALLING_CODES or code[:2] in LONG_CALLING_CODES
        return YES if known else NO
    return NOTHING


def _words_near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to four lower-case words before a span, last first, and two after it."""
    before = _WORD.findall(text[max(0, start - 48) : start].lower())[::-1][:4]
    return before, _WORD.findall(text[end : end + 24].lower())[:2]


def _context(kind: int, before: list[str]) -> str:
    if _CUES[kind].intersection(before):
        return YES
    return NO if _OTHERS.intersection(before[:2]) else NOTHING


def _border(text: str, start: int, end: int) -> str:
    left, right = text[start - 1 : start], text[end : end + 1]
    return NO if left.isalnum() or right.isalnum() or left in ("_", "#", "=") else YES


def features(text: str, span: Span, votes: str, before: list[str], after: list[str]) -> list[int]:
    """Hashed columns of a candidate's form, borders, words around and votes."""
    start, end, kind = span
    body = text[start:end]
    form = re.sub(r"(.)\1+", r"\1", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", body[:64])))
    named = [
        f"form {form[:24]}", f"digits {min(24, len(_DIGIT.findall(body)))}", f"size {min(64, end - start) // 4}",
        f"left {text[start - 1 : start]}", f"right {text[end : end + 1]}",
        *(f"before {w}" for w in before[:2]), *(f"after {w}" for w in after[:1]),
        *(f"{name} {vote}" for name, vote in zip(LABELERS, votes, strict=True)), "",
    ]
    return [zlib.crc32(f"{kind} {n}".encode("utf-8", "surrogatepass")) % DIMENSIONS for n in named]


def candidates(text: str) -> tuple[list[Span], list[tuple[Span, str, list[int]]]]:
    """(spans of the fixed rules, all candidates with votes and features)."""
    spans, failed = fixed_rules(text)
    if not spans and not failed and "at" not in text and not _DIGIT.search(text):
        return [], []
    ways = {s: YES for s in spans} | {s: NO for s in failed}
    borders = merged(spans)
    for s in loose_spans(text):
        # what the rules found is settled, and so is what overlaps it
        if not overlaps(borders, s[0], s[1]):
            ways.setdefault(s, NOTHING)
    out = []
    for span in sorted(ways):
        start, end, kind = span
        body = text[start:end]
        digits = digits_of(body)
        before, after = _words_near(text, start, end)
        votes = "".join((
            ways[span], _check(kind, body, digits), _gazetteer(kind, body, digits), _context(kind, before),
            _border(text, start, end),
        ))
        out.append((span, votes, features(text, span, votes, before, after)))
    return spans, out


@dataclass(frozen=True)
class Reliability:
    """Per kind: share of personal data, and of each vote given the truth."""

    share: float
    #: votes[truth][labeler][vote], in the order of "yn-".
    votes: np.ndarray

    def likelihood(self, pattern: str) -> float:
        """How likely a candidate with these votes is personal data."""
        log = [np.log(1 - self.share), np.log(self.share)]
        for truth in (0, 1):
            log[truth] += sum(np.log(self.votes[truth, k, "yn-".index(v)]) for k, v in enumerate(pattern))
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))))


def reliabilities(counts: dict[str, int], rounds: int = 100) -> Reliability:
    """Expectation-maximisation over vote patterns with their counts.

    Starts from the majority; every vote has been seen ``prior`` times, mostly as a better
    than random labeler would cast it, which also keeps the two classes from trading places.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    cast = np.array([["yn-".index(v) for v in p] for p in patterns], np.int64)
    cast = cast.reshape(len(patterns), len(LABELERS))
    prior = np.array([[2.0, 6.0, 4.0], [6.0, 2.0, 4.0]])[:, None, :] * np.ones((2, len(LABELERS), 1))
    lead = (cast == 0).sum(axis=1) - (cast == 1).sum(axis=1)
    likely = 1 / (1 + np.exp(-2.0 * lead))
    for _ in range(rounds):
        votes = prior.copy()
        for truth, weight in ((0, n * (1 - likely)), (1, n * likely)):
            for k in range(len(LABELERS)):
                votes[truth, k] += np.bincount(cast[:, k], weight, 3)
        votes /= votes.sum(axis=2, keepdims=True)
        share = float(((n * likely).sum() + 1) / (n.sum() + 2))
        log = np.log(votes)[:, np.arange(len(LABELERS))[None, :], cast].sum(axis=2) if len(patterns) else np.zeros((2, 0))
        new = 1 / (1 + np.exp(np.clip(np.log(1 - share) + log[0] - np.log(share) - log[1], -500, 500)))
        if len(new) == 0 or np.abs(new - likely).max() < 1e-9:
            break
        likely = new
    return Reliability(share, votes)


def fit_spans(rows: Iterable[tuple[list[int], float]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on likelihoods as targets (full-batch Adam)."""
    rows = list(rows)
    weights, m1, m2 = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    if not rows:
        return weights
    sizes = np.array([len(f) for f, _ in rows])
    flat = np.concatenate([np.array(f, np.int64) for f, _ in rows])
    starts = np.cumsum(sizes) - sizes
    target = np.array([t for _, t in rows])
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[flat], starts), -500, 500)))
        grad = np.bincount(flat, np.repeat((p - target) / len(rows), sizes), DIMENSIONS) + decay * weights
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        weights -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return weights


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
_CANDIDATE = pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("votes", pa.string()),
    ("features", pa.list_(pa.int32())),
])
_SCANNED = (
    "doc_id bigint, base array<struct<start:bigint,end:bigint,kind:int>>, "
    "found array<struct<start:bigint,end:bigint,kind:int,votes:string,features:array<int>>>"
)


def _named(span: Span) -> dict:
    return dict(zip(("start", "end", "kind"), span, strict=True))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            base, found = [], []
            for text in part.column("text").to_pylist():
                spans, proposed = candidates(text or "")
                base.append([_named(s) for s in spans])
                found.append([{**_named(s), "votes": v, "features": f} for s, v, f in proposed])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(base, pa.list_(_SPAN)),
                 pa.array(found, pa.list_(_CANDIDATE))],
                names=["doc_id", "base", "found"],
            )


def _decide(weights: np.ndarray, accept: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spans of each row: those of the rules and accepted candidates that touch none."""
    kind = pa.struct([*_SPAN, ("p", pa.float64())])
    for batch in batches:
        spans = []
        for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
            taken = [{**s, "p": 1.0} for s in base]
            scored = []
            for c in found:
                p = float(1 / (1 + np.exp(-np.clip(weights[c["features"]].sum(), -500, 500))))
                if p >= accept:
                    scored.append((-p, c["start"], c["end"], c["kind"]))
            busy = merged([(s["start"], s["end"], s["kind"]) for s in base])
            for p, start, end, k in sorted(scored):
                if not overlaps(busy, start, end):
                    insort(busy, (start, end))
                    taken.append({"start": start, "end": end, "kind": k, "p": -p})
            spans.append(sorted(taken, key=lambda s: (s["start"], s["kind"])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("base"), pa.array(spans, pa.list_(kind))],
            names=["doc_id", "base", "spans"],
        )


def personal_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_spans_most: int = FIT_SPANS, accept: float = ACCEPT
) -> DataFrame:
    """(doc_id, base, spans) per input row; spans hold start, end, kind (number) and p.

    ``base`` are the spans of the fixed rules, which are in ``spans`` with p = 1; code points,
    end exclusive.  NULL and empty texts have none.  Rows do not depend on one another apart
    from the counts of votes, so ties, repeated rows and NULL ids need no rule; an empty
    table gives an empty table; other columns are not read.  At most ``fit_spans_most``
    candidates, of the lowest hash, fit the classifier; votes are counted over all.
    """
    scanned = written(slim(docs, doc_id=doc_id, text=text).mapInArrow(_scan, _SCANNED), "spans")
    each = scanned.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    # at most 4 kinds x 3^5 patterns
    votes = each.groupBy("kind", "votes").count().collect()
    trust = {
        k: reliabilities({r["votes"]: r["count"] for r in votes if r["kind"] == k}) for k in range(len(KINDS))
    }
    sample = each.orderBy(F.xxhash64("doc_id", "kind", "start", "end"), "doc_id", "kind", "start", "end", "votes").limit(
        fit_spans_most
    ).select("kind", "votes", "features").collect()
    weights = fit_spans((r["features"], trust[r["kind"]].likelihood(r["votes"])) for r in sample)
    return scanned.mapInArrow(
        partial(_decide, weights, accept),
        "doc_id bigint, base array<struct<start:bigint,end:bigint,kind:int>>, "
        "spans array<struct<start:bigint,end:bigint,kind:int,p:double>>",
    )


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the fixed rules' spans, and all spans as text."""
    found = personal_data(docs)
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )
