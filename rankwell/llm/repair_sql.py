"""Oracle SQL of the conversation repair: one walk over the turns with four grammar states.

Each state holds the least (cost, audit, repaired lines) of its kind.  It knows nothing of
target lengths, bands or pieces, so it checks all of them.
"""

from __future__ import annotations


def crc32_sql(key: str, table: str = "crc") -> str:
    """crc32 of an ASCII string; ``table`` is the 256-entry list made by ``CRC_TABLE``."""
    codes = f"list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)"
    walk = f"lambda c, b: xor(c // 256, {table}[(xor(c, b) % 256 + 1)::INTEGER])"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), {walk}))"


CRC_TABLE = """
    SELECT list(c ORDER BY i) AS crc FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
        FROM range(256) r(i))
"""


def _step(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 't': {state}.t || '{letter}', 'r': {state}.r || {line}}}"


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _took(state: str, initial: str) -> str:
    """The row becomes the turn ``initial``: kept if it is one, else with another role."""
    cost = f"CASE WHEN kind = 'gone' THEN 1000000000 ELSE (kind = 'open')::INT * 3 + (first <> '{initial}')::INT * %s END"
    keep = "role || ':' || text || chr(10)"
    if initial == "s":
        return f"{{'c': {state}.c + {cost % 1000000000}, 't': {state}.t || 'K', 'r': {state}.r || {keep}}}"
    name = {"u": "user", "a": "assistant"}[initial]
    letter = f"CASE WHEN first = '{initial}' THEN 'K' ELSE 'R' END"
    line = f"CASE WHEN first = '{initial}' THEN role ELSE '{name}' END || ':' || text || chr(10)"
    return f"{{'c': {state}.c + {cost % 3}, 't': {state}.t || {letter}, 'r': {state}.r || {line}}}"


def _inserted(state: str, initial: str) -> str:
    return _step(state, "3", "I", f"'{dict(u='user', a='assistant')[initial]}:' || chr(10)")


_FAR = "{'c': 1000000000, 't': '', 'r': ''}"

CONVERSATION_REPAIR = rf"""
    WITH RECURSIVE tab AS ({CRC_TABLE}), dealt AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS deal
        FROM conversations, tab
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
            CASE deal WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(CASE WHEN deal = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM dealt WHERE deal <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS no
        FROM damaged
    ), judged AS (
        SELECT *, left(role, 1) AS first, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY no) AS next,
            CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY no) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
        FROM placed
    ), turns AS (
        SELECT conv_id, no, role, text, first, CASE fault WHEN '' THEN 'fine' WHEN 'truncated' THEN 'open' ELSE 'gone' END AS kind
        FROM judged
    ), counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
            count_if(fault = 'truncated') AS truncated,
            count_if(next IS NOT NULL AND first || next NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id
    ), walk AS (
        SELECT conv_id, 0::BIGINT AS no, {{'c': 0, 't': '', 'r': ''}} AS e, {_FAR} AS s, {_FAR} AS u, {_FAR} AS a
        FROM counts
        UNION ALL
        SELECT conv_id, no,
            {_step('e', '4', 'D')},
            {_least(_step('s', '4', 'D'), _took('e', 's'))},
            {_least(_step('u', '4', 'D'), _took('e', 'u'), _took('s', 'u'), _took('a', 'u'))},
            {_least(_step('a', '4', 'D'), _took('u', 'a'))}
        FROM (
            SELECT * REPLACE ({_least('a', _inserted('u', 'a'))} AS a) FROM (
                SELECT w.conv_id, t.no, t.role, t.text, t.first, t.kind, e, s, a,
                    {_least('u', _inserted('e', 'u'), _inserted('s', 'u'), _inserted('a', 'u'))} AS u
                FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.no = w.no + 1
            )
        )
    ), ended AS (
        SELECT w.conv_id, {_least('e', 'a', _inserted('u', 'a'), _inserted('(' + _inserted('s', 'u') + ')', 'a'))} AS best
        FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.no
    )
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
        coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
        coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.t, '') AS audit,
        sha256(CASE WHEN coalesce(best.r, '') = '' THEN '' ELSE left(best.r, length(best.r) - 1) END) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
