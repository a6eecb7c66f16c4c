"""Conversation repair against a walk over grammar states and by hand."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from rankwell.llm.conversation_repair import Piece, damaged_turns, repair_digests, repaired_conversations
from rankwell.llm.repair_sql import CONVERSATION_REPAIR

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, no bigint, audit string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def walked(turns):
    """Least (cost, audit) by states; turns are (initial, 0 fine / 1 truncated / 2 gone)."""
    states = {"": (0, "")}

    def offer(table, state, cost, audit):
        table[state] = min(table.get(state, (1 << 40, "")), (cost, audit))

    def inserted(table):
        table = dict(table)
        for state in ("", "s", "a"):
            if state in table:
                offer(table, "u", table[state][0] + 3, table[state][1] + "I")
        if "u" in table:
            offer(table, "a", table["u"][0] + 3, table["u"][1] + "I")
        if "a" in table:
            offer(table, "u", table["a"][0] + 3, table["a"][1] + "I")
        return table

    for initial, kind in turns:
        new = {}
        for state, (cost, audit) in inserted(states).items():
            offer(new, state, cost + 4, audit + "D")
            if kind != 2:
                for to in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    if to == initial:
                        offer(new, to, cost + 3 * kind, audit + "K")
                    elif to != "s":
                        offer(new, to, cost + 3 * kind + 3, audit + "R")
        states = new
    ends = {k: v for k, v in inserted(inserted(states)).items() if k in ("", "a")}
    return min(ends.values())


def test_pieces_equal_the_walk_on_all_short_conversations():
    for n in range(1, 5):
        for turns in itertools.product(itertools.product("sux", (0, 1, 2)), repeat=n):
            assert Piece(list(turns)).whole()[:2] == walked(turns)


def test_pieces_equal_the_walk_on_random_conversations():
    rnd = random.Random(7)
    for _ in range(300):
        turns = [(rnd.choice("uasuaua"), rnd.choice((0, 0, 0, 1, 2))) for _ in range(rnd.randrange(1, 40))]
        assert Piece(turns).whole()[:2] == walked(turns)


def brute(rows):
    """{conv_id: (counts, cost, audit, lines)} of undamaged rows."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, turns, faults = set(), [], defaultdict(int)
        for _, role, text in held:
            shown = text.strip(" \t\n\v\f\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else (
                "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
            faults[fault] += 1
            turns.append((role[:1], {"": 0, "truncated": 1}.get(fault, 2)))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        numbers = [t for t, _, _ in held if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = walked(turns)
        lines, left = [], iter(held)
        state = ""
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            to = row[1][:1] if letter == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            role = row[1] if letter == "K" else {"u": "user", "a": "assistant"}[to]
            lines.append((role, row[2] if row else ""))
            state = to
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, lines)
    return out


def odd_rows():
    rnd = random.Random(3)
    said = ["Yes.", "No!", "cut", "", " \n", "Why?", "x" * 70_000 + ".", "a-", None]
    rows = []
    for conv in [None, *range(30)]:
        for turn in range(rnd.randrange(1, 12)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "", None, "tool", "unit"])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn - 1]), role, rnd.choice(said)))
    rows += [(40, 3, "user", "Same.")] * 150  # one row many times over
    rows += [(41, -(1 << 40), "user", "A."), (41, 1 << 40, "assistant", "B.")]
    for turn in range(9000):  # two levels of folds
        if rnd.random() < 0.9:
            role = rnd.choice(["user", "assistant"][turn % 2 : turn % 2 + 1] * 9 + ["user", "system"])
            rows.append((50, turn, role, rnd.choice(["Well {}.", "Hm {}", "", "Same."]).format(turn)))
    rnd.shuffle(rows)
    return rows


def test_repair_equals_brute_force(spark):
    rows = odd_rows()
    reports, repaired = repaired_conversations(turns_of(spark, rows).repartition(7))
    want = brute(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in reports.collect()}
    assert got == {conv: w[:-1] for conv, w in want.items()}
    lines = defaultdict(list)
    for r in repaired.collect():
        lines[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    for conv, w in want.items():
        assert [x[0] for x in sorted(lines[conv])] == list(range(len(w[-1])))
        assert [x[1:] for x in sorted(lines[conv])] == w[-1]


def test_digests_equal_the_sql_walk(spark):
    rows = [r for r in odd_rows() if r[0] != 50]
    rows = list(dict.fromkeys(rows)) + [(60, 1, "user", "A."), (60, 1, "user", "A.")]
    # one conversation loses all its rows
    lost = next(t for t in range(1000) if zlib.crc32(f"70:{t}".encode()) % 20 == 0)
    rows.append((70, lost, "user", "Gone."))
    frame = turns_of(spark, rows)
    got = repair_digests(frame)
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    cursor = con.execute(CONVERSATION_REPAIR)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want))
    gone = next(r for r in got.collect() if r["conv_id"] == 70)
    assert (gone["audit"], gone["cost"], gone["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())


def test_damage_by_key(spark):
    rows = [(1, t, "assistant", "One. Two!") for t in range(200)] + [(None, None, None, None)]
    got = defaultdict(list)
    for r in damaged_turns(turns_of(spark, rows)).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"]))
    for conv, turn, role, text in rows:
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        one = (role or " ", text or " ")
        want = {0: [], 1: [(one[0], "")], 2: [(one[0], one[1].translate({46: None, 33: None}))], 3: [one, one],
                4: [("user", one[1])]}.get(deal, [one])
        assert got[conv, turn] == want


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)]])
def test_no_conversations(spark, rows):
    reports, repaired = repaired_conversations(turns_of(spark, rows))
    assert [(r["cost"], r["audit"]) for r in reports.collect()] == [(4, "D")] * len(rows)
    assert repaired.count() == 0
    assert repair_digests(turns_of(spark, rows)).count() == len(rows)
