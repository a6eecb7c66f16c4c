"""Repair of conversations by alignment to an alternating grammar.

The roles of a sound conversation read ``(s?(ua)+)?``: nothing, or an optional system
turn and then user and assistant in turn.  A conversation is aligned (Wagner and Fischer)
to each feasible length of that string.  Lengths come in the order of a lower bound, and
the best cost so far closes all further lengths and, as Ukkonen's band, all diagonals that
would cost more.  Of equally cheap alignments the one whose backtraced audit is least in
ASCII order stands.

A long conversation is cut into pieces of ``PIECE`` turns.  A piece is aligned from each
state of the grammar to each other one; pieces then fold by 64, level by level, since the
cheapest way through two pieces is a least sum over the state between them.  No insertion
may close a piece, so an audit has one cutting only and equal costs stay comparable.  No
task ever holds more than 64 pieces of one conversation, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.common import slim
from rankwell.session import written

#: Turns of a piece, and pieces that fold into one.
PIECE = 64
FOLD = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\v\f\r"
#: What a turn may be: fit to stay, cut off at its end, or to be deleted.
FINE, OPEN, GONE = 0, 1, 2
#: The role that follows a state, and the insertions that end the string there.
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
CLOSING = {"": "", "s": "II", "u": "I", "a": ""}
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
FAR = 1 << 60

Turn = tuple[str, int]  # initial of the role, and FINE, OPEN or GONE


def alternation(start: str, length: int) -> str:
    """The ``length`` roles after ``start``, by initial."""
    first = FOLLOWS[start]
    return ("ua" if first == "u" else "au") * (length // 2) + first * (length % 2)


def targets(start: str, most: int, system: bool) -> list[str]:
    """Every string of at most ``most`` roles that may follow ``start``."""
    plain = [alternation(start, k) for k in range(most + 1)]
    if start or not system:
        return plain
    return plain + ["s" + alternation("s", k) for k in range(most)]


class Piece:
    """Turns with what all their alignments share."""

    def __init__(self, turns: list[Turn]) -> None:
        self.turns = turns
        live = [kind for _, kind in turns if kind != GONE]
        self.live = len(live)
        self.least = DELETE * (len(turns) - len(live)) + TRUNCATED * live.count(OPEN)
        #: What deleting a live turn costs at least on top of ``least``.
        self.drop = DELETE - TRUNCATED if OPEN in live else DELETE
        self.system = any(i == "s" and kind != GONE for i, kind in turns)

    def bend(self, gap: int) -> int:
        """Least cost of ``gap`` roles more (or less) than live turns."""
        return INSERT * gap if gap >= 0 else -self.drop * gap

    def bound(self, target: str) -> int:
        return self.least + self.bend(len(target) - self.live)

    def aligned(self, target: str, most: int) -> tuple[int, str] | None:
        """The least cost up to ``most`` and its least audit; no insertion comes last."""
        gap, slack = len(target) - self.live, most - self.least
        reach = range(-len(self.turns) - 1, len(target) + 2)
        band = [d for d in reach if self.bend(d) + self.bend(gap - d) <= slack]
        if not band:
            return None
        n, size, low, high = len(self.turns), len(target), band[0], band[-1]
        rest = [[FAR] * (size + 2) for _ in range(n + 1)]
        rest[n][size] = 0
        live = self.live
        for i in range(n - 1, -1, -1):
            initial, kind = self.turns[i]
            live -= kind != GONE
            row, below = rest[i], rest[i + 1]
            extra = TRUNCATED if kind == OPEN else 0
            for j in range(min(size, live + high), max(0, live + low) - 1, -1):
                best = below[j] + DELETE
                if j < size:
                    role = target[j]
                    if kind != GONE and (initial == role or role != "s"):
                        best = min(best, below[j + 1] + extra + (KEEP if initial == role else REROLE))
                    if role != "s":
                        best = min(best, row[j + 1] + INSERT)
                row[j] = best
        if rest[0][0] > most:
            return None
        return rest[0][0], self._audit(target, rest)

    def _audit(self, target: str, rest: list[list[int]]) -> str:
        """The least letters along cells of least cost: D before I before K before R."""
        letters: list[str] = []
        i = j = 0
        while i < len(self.turns):
            initial, kind = self.turns[i]
            here, role = rest[i][j], target[j : j + 1]
            if rest[i + 1][j] + DELETE == here:
                letters.append("D")
                i += 1
            elif role and role != "s" and rest[i][j + 1] + INSERT == here:
                letters.append("I")
                j += 1
            else:
                letters.append("K" if initial == role else "R")
                i, j = i + 1, j + 1
        return "".join(letters)

    def cheapest(self, choices: Iterable[tuple[str, str]]) -> tuple[int, str, bool] | None:
        """Over (target, closing letters): cost, audit, whether a system turn opens it."""
        best: tuple[int, str, bool] | None = None
        ranked = sorted((self.bound(t) + INSERT * len(tail), t, tail) for t, tail in choices)
        for bound, target, tail in ranked:
            if best and bound > best[0]:
                break
            if best:
                found = self.aligned(target, best[0] - INSERT * len(tail))
            else:
                most, worst = self.bound(target), DELETE * len(self.turns) + INSERT * len(target)
                found = self.aligned(target, most)
                while not found and most < worst:
                    most = min(worst, 2 * most + INSERT)
                    found = self.aligned(target, most)
            if found:
                new = (found[0] + INSERT * len(tail), found[1] + tail, target[:1] == "s")
                best = min(best, new) if best else new
        return best

    def whole(self) -> tuple[int, str, bool]:
        """The cheapest repair of a conversation that this piece holds whole."""
        strings = targets("", 2 * len(self.turns) + 2, self.system)
        return self.cheapest((t, CLOSING[t[-1:]]) for t in strings)

    def ways(self) -> list[dict]:
        """The cheapest alignment from each state to each state it can end in."""
        found = []
        for start in FOLLOWS:
            strings = targets(start, 2 * len(self.turns) + 2, self.system)
            for end in FOLLOWS:
                best = self.cheapest((t, "") for t in strings if (t[-1:] or start) == end)
                if best:
                    found.append(_way(start, end, *best))
        return found


def _way(start: str, end: str, cost: int, audit: str, system: bool) -> dict:
    return {"start": start, "end": end, "cost": cost, "audit": audit, "system": system}


WAY = pa.struct([
    ("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string()),
    ("system", pa.bool_()),
])
MEMBER = pa.struct([("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())])
#: Sums of a piece: they add up when pieces fold, apart from what meets at the cut.
COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
SUMS = [(name, pa.int64()) for name in COUNTS]
EDGES = [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first", pa.string()), ("last", pa.string())]
_SUMS_SQL = ", ".join(f"{c} bigint" for c in COUNTS) + ", first_turn bigint, last_turn bigint, first string, last string"
_WAYS_SQL = "ways array<struct<start:string,end:string,cost:bigint,audit:string,system:boolean>>"
_MEMBERS_SQL = "members array<struct<at:bigint,turn:bigint,role:string,digest:binary>>"


def _sums(rows: list[dict]) -> dict:
    """Counts of consecutive turns; ``turns`` are the different turn numbers."""
    initials = [r["role"][:1] for r in rows]
    numbers = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "rows": len(rows),
        **{fault: sum(r["fault"] == fault for r in rows) for fault in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False)),
        "turns": len(set(numbers)),
        "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None,
        "first": initials[0], "last": initials[-1],
    }


def _joined(a: dict, b: dict) -> dict:
    """Counts and ways of ``a`` followed by ``b``."""
    out = {c: a[c] + b[c] for c in COUNTS}
    out["illegal"] += a["last"] + b["first"] not in LEGAL_PAIRS
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    out |= {"first": a["first"], "last": b["last"]}
    best: dict[tuple[str, str], tuple[int, str, bool]] = {}
    for x in a["ways"]:
        for y in b["ways"]:
            if x["end"] == y["start"]:
                key = x["start"], y["end"]
                new = (x["cost"] + y["cost"], x["audit"] + y["audit"], x["system"] or y["system"])
                best[key] = min(best.get(key, new), new)
    out["ways"] = [_way(*key, *value) for key, value in best.items()]
    return out


def _fault(row: dict, repeat: bool) -> str:
    if row["blank"]:
        return "blank"
    return "duplicate" if row["again"] or repeat else "truncated" if row["open"] else ""


def _pieces(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order as pieces; a conversation that this partition may share stays open."""
    part = TaskContext.get().partitionId()
    out: list[dict] = []

    def piece(conv: object, no: int, at: int, rows: list[dict], whole: bool) -> dict:
        kinds = {"": FINE, "truncated": OPEN}
        held = Piece([(r["role"][:1], kinds.get(r["fault"], GONE)) for r in rows])
        ways = [_way("", "", *held.whole())] if whole else held.ways()
        members = [
            {"at": at + k, "turn": r["turn"], "role": r["role"], "digest": r["digest"]}
            for k, r in enumerate(rows) if r["fault"] in kinds
        ]
        return {"conv_id": conv, "part": part, "no": no, "at": at, "whole": whole, "ways": ways, "members": members,
                **_sums(rows)}

    def batch() -> pa.RecordBatch:
        schema = pa.schema([
            ("conv_id", kind), ("part", pa.int32()), ("no", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()),
            ("ways", pa.list_(WAY)), ("members", pa.list_(MEMBER)), *SUMS, *EDGES,
        ])
        made = pa.RecordBatch.from_pylist(out, schema=schema)
        out.clear()
        return made

    conv: object = None
    rows: list[dict] = []
    no, at, runs = 0, 0, 0
    for got in batches:
        for row in got.to_pylist():
            if runs == 0 or row["conv_id"] != conv:
                if rows:
                    # the first run of a partition may have begun in the one before
                    out.append(piece(conv, no, at, rows, whole=no == 0 and runs > 1))
                conv, rows, no, at, runs = row["conv_id"], [], 0, 0, runs + 1
            for copy in range(row["n"]):
                if len(rows) == PIECE:
                    out.append(piece(conv, no, at, rows, whole=False))
                    rows, no, at = [], no + 1, at + PIECE
                rows.append({**row, "fault": _fault(row, copy > 0)})
                if len(out) >= 1000:
                    yield batch()
    if rows:
        out.append(piece(conv, no, at, rows, whole=False))
    yield batch()


def _folded(kind: pa.DataType, key: tuple, table: pa.Table) -> pa.Table:
    """Up to ``FOLD`` neighbouring pieces of one conversation as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    total = rows[0]
    for row in rows[1:]:
        total = _joined(total, row)
    names = [*COUNTS, *(n for n, _ in EDGES), "ways"]
    made = {"conv_id": rows[0]["conv_id"], "no": rows[0]["no"] // FOLD} | {n: total[n] for n in names}
    schema = pa.schema([("conv_id", kind), ("no", pa.int64()), *SUMS, *EDGES, ("ways", pa.list_(WAY))])
    return pa.Table.from_pylist([made], schema=schema)


def _closed(ways: Column) -> Column:
    """The cheapest way from the empty state, closed by insertions."""
    tail = F.create_map(*[F.lit(x) for pair in CLOSING.items() for x in pair])
    from_start = F.filter(ways, lambda w: w["start"] == "")
    return F.array_min(F.transform(from_start, lambda w: F.struct(
        (w["cost"] + INSERT * F.length(tail[w["end"]])).alias("cost"),
        F.concat(w["audit"], tail[w["end"]]).alias("audit"), w["system"].alias("system"),
    )))


def _replayed(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that an audit leaves: their place, their row (none if inserted), a new role."""
    names = ("conv_id", "at", "place", "edit", "role")
    kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        for conv, audit, system in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "system")),
                                       strict=True):
            rows: list[list] = [[] for _ in names]
            at = place = 0
            for letter in audit:
                if letter != "D":
                    # a system turn is always the first that stays, and kept
                    initial = "ua"[(place - system) % 2]
                    role = None if letter == "K" else ROLES[initial]
                    row = (conv, None if letter == "I" else at, place, letter, role)
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                    place += 1
                at += letter != "I"
                if len(rows[0]) >= 10_000:
                    yield _arrays(rows, kinds, names)
                    rows = [[] for _ in names]
            yield _arrays(rows, kinds, names)


def _arrays(columns: list[list], kinds: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names)
    )


def _same(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys are equal; the keys of ``left`` stay."""
    keys = list(keys)
    marked = right.select(*[F.col(c).alias(f"right {c}" if c in keys else c) for c in right.columns])
    match = [F.col(k).eqNullSafe(F.col(f"right {k}")) for k in keys]
    return left.join(marked, match, how).drop(*[f"right {k}" for k in keys])


def repaired_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired turns) of all conversations.

    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    repaired turns: conv_id, place (from 0), edit (K, R or I), role, text.

    Turns come by number (NULL first), then role, then digest of the text; equal rows stand
    next to each other, and all but one are duplicates.  A NULL role or text is one space; a
    NULL conversation is one conversation; NULL numbers leave no gaps.  An empty role fits no
    place of the grammar.  A turn is blank, else a duplicate of an earlier one, else
    truncated, if any.  Conversations of any length are aligned whole.  An empty table gives
    empty tables; other columns are not read.
    """
    spark = turns.sparkSession
    kind = spark.createDataFrame([], turns.select(F.col(f"`{conv_id}`")).schema).toArrow().schema.field(0).type
    own = slim(turns, conv_id=conv_id, turn=turn, role=role, text=text).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    own = own.withColumn("digest", F.unhex(F.sha2("text", 256)))
    shown = F.rtrim("text", F.lit(BLANKS))
    when = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("no"))
    rows = own.select(
        "conv_id", "turn", "role", "digest", (shown == "").alias("blank"),
        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("open"),
    ).groupBy("conv_id", "turn", "role", "digest", "blank", "open").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"))
    again = _same(rows, first, ("conv_id", "role", "digest")).select(
        "conv_id", "turn", "role", "digest", "n", "blank", "open",
        F.coalesce(when > F.col("first"), F.lit(False)).alias("again"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    in_order = again.repartitionByRange(*order).sortWithinPartitions(*order)
    conv_sql = turns.schema[conv_id].dataType.simpleString()
    pieces = written(
        in_order.mapInArrow(
            lambda batches: _pieces(kind, batches),
            f"conv_id {conv_sql}, part int, no bigint, at bigint, whole boolean, {_WAYS_SQL}, {_MEMBERS_SQL}, {_SUMS_SQL}",
        ),
        "pieces",
    )
    sums = [*COUNTS, *(n for n, _ in EDGES)]
    # a conversation in several partitions: its pieces and rows before each of them
    spans = pieces.filter(~F.col("whole")).groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("rows").alias("rows")
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "conv_id", "part", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("pieces_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    cut = _same(pieces.filter(~F.col("whole")).drop("members"), spans, ("conv_id", "part")).select(
        "conv_id", (F.col("no") + F.col("pieces_before")).alias("no"), *sums, "ways"
    )
    cut = written(cut, "cut")
    while cut.agg(F.max("no")).first()[0]:
        folded = cut.withColumn("fold", F.floor(F.col("no") / FOLD)).groupBy("conv_id", "fold").applyInArrow(
            lambda key, table: _folded(kind, key, table), f"conv_id {conv_sql}, no bigint, {_SUMS_SQL}, {_WAYS_SQL}"
        )
        cut = written(folded, "cut")
    best = _closed(F.col("ways"))
    ended = pieces.filter("whole").select("conv_id", *sums, F.col("ways")[0].alias("best")).select(
        "conv_id", *sums, F.struct("best.cost", "best.audit", "best.system").alias("best")
    ).unionByName(cut.select("conv_id", *sums, best.alias("best")))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    reports = ended.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit",
        "best.system",
    )
    left = reports.mapInArrow(
        lambda batches: _replayed(kind, batches), f"conv_id {conv_sql}, at bigint, place bigint, edit string, role string"
    )
    members = _same(pieces.select("conv_id", "part", F.explode("members").alias("m")), spans, ("conv_id", "part"), "left")
    members = members.select(
        "conv_id", (F.col("m.at") + F.coalesce("rows_before", F.lit(0))).alias("at"), "m.turn",
        F.col("m.role").alias("old_role"), "m.digest",
    )
    texts = own.groupBy("conv_id", "turn", "role", "digest").agg(F.any_value("text").alias("text"))
    stay = _same(left.filter("at IS NOT NULL"), members, ("conv_id", "at")).select(
        "conv_id", "turn", F.col("old_role").alias("role"), "digest", "place", "edit", F.col("role").alias("new_role")
    )
    stay = _same(stay, texts, ("conv_id", "turn", "role", "digest")).select(
        "conv_id", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text"
    )
    inserted = left.filter("at IS NULL").select("conv_id", "place", "edit", "role", F.lit("").alias("text"))
    return reports.drop("system"), stay.unionByName(inserted)


def damaged_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults dealt by crc32("conv_id:turn") modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats it, 4 makes it the
    user's.  NULLs become one space, in the key as well; conv_id and turn stay NULL.
    """
    own = slim(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    deal = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    rows = own.withColumn("deal", deal).filter("deal <> 0").select(
        "conv_id", "turn", F.when(F.col("deal") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _digests(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 over the ``role:text`` lines of each conversation, as a stream."""
    import hashlib

    done: list[tuple[object, str]] = []
    conv: object = None
    sha = None
    for batch in batches:
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if sha is not None and key == conv:
                sha.update(b"\n")
            else:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = key, hashlib.sha256()
            sha.update(f"{role}:{text}".encode())
        if done:
            yield _arrays([list(c) for c in zip(*done, strict=True)], (kind, pa.string()), ("conv_id", "repaired_sha256"))
            done = []
    if sha is not None:
        yield _arrays([[conv], [sha.hexdigest()]], (kind, pa.string()), ("conv_id", "repaired_sha256"))


def repair_digests(turns: DataFrame) -> DataFrame:
    """Damages the turns, repairs them, and gives one row per conversation of ``turns``.

    Conversations that lost all rows count nothing, have an empty audit and the digest of
    the empty string.  The digest of one conversation is sequential, so its repaired turns
    pass through one task, as a stream.
    """
    reports, repaired = repaired_conversations(damaged_turns(turns))
    kind = turns.sparkSession.createDataFrame([], turns.select("conv_id").schema).toArrow().schema.field(0).type
    conv_sql = turns.schema["conv_id"].dataType.simpleString()
    digests = (
        repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
        .mapInArrow(lambda batches: _digests(kind, batches), f"conv_id {conv_sql}, repaired_sha256 string")
    )
    every = slim(turns, conv_id="conv_id").distinct()
    found = _same(_same(every, reports, ["conv_id"], "left"), digests, ["conv_id"], "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lower(F.sha2(F.lit(""), 256))).alias("repaired_sha256"),
    )
