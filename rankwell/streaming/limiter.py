"""Token buckets per key: as a streaming state, and as a batch over a whole log.

A bucket starts full.  Time since the last request refills it up to its
capacity; an allowed request costs one token, a refused one still refills.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankwell.session import written

# Bucket size and refill rate.
CAPACITY = 20.0
REFILL_PER_SECOND = 0.5


@dataclass(frozen=True)
class Bucket:
    capacity: float = CAPACITY
    refill: float = REFILL_PER_SECOND
    #: Event seconds per bucket second; above 1 replays a slow log faster.
    time_scale: float = 1.0


@dataclass(frozen=True)
class Credit:
    """A bucket in whole numbers: ``per_microsecond`` refills it, a request takes ``cost``.

    Whole numbers add up alike in any order, so blocks decide as one walk would.
    """

    per_microsecond: int
    cost: int
    full: int

    @staticmethod
    def of(bucket: Bucket) -> Credit:
        # as written: 0.1 is a tenth
        capacity, refill, scale = (Fraction(str(x)) for x in (bucket.capacity, bucket.refill, bucket.time_scale))
        cost = 1_000_000 * scale / refill
        full = cost * capacity
        scale = cost.denominator * full.denominator
        return Credit(scale, int(cost * scale), int(full * scale))

    def decided(self, times: Sequence[int], credit: int, last: int | None) -> tuple[list[bool], int]:
        """Flags of requests in order of time, and the credit after them."""
        flags = []
        for now in times:
            if last is not None:
                credit = min(self.full, credit + max(0, now - last) * self.per_microsecond)
            last = now
            flags.append(credit >= self.cost)
            if flags[-1]:
                credit -= self.cost
        return flags, credit


#: From an input on, the credit after a block: it moves with the input, or stays.
Stretch = tuple[int, int, bool]


def block_map(times: Sequence[int], credit: Credit) -> list[Stretch]:
    """The credit after a block of requests as a function of the credit at its first one.

    More credit never lets fewer requests pass, and a full bucket lets at most its capacity
    more of them pass than an empty one.  So the function has few stretches, however long
    the block is: about two for each request that the bucket holds.
    """
    stretches: list[Stretch] = [(0, 0, True)]
    last = times[0] if times else 0
    cost, full = credit.cost, credit.full
    for now in times:
        gained = (now - last) * credit.per_microsecond
        last = now
        after: list[Stretch] = []
        ends = [s[0] for s in stretches[1:]] + [full + 1]
        for (start, value, moves), end in zip(stretches, ends, strict=True):
            value += gained
            if not moves:
                value = min(full, value)
                _append(after, (start, value - cost if value >= cost else value, False))
                continue
            # refused, allowed, and allowed with a full bucket
            pays = min(end, max(start, start + cost - value))
            tops = min(end, max(pays, start + full - value))
            if start < pays:
                _append(after, (start, value, True))
            if pays < tops:
                _append(after, (pays, value + pays - start - cost, True))
            if tops < end:
                _append(after, (tops, full - cost, False))
        stretches = after
    return stretches


def _append(stretches: list[Stretch], new: Stretch) -> None:
    """Adds a stretch unless the last one goes on with the same values."""
    if stretches and stretches[-1][2] == new[2]:
        start, value, moves = stretches[-1]
        if new[1] == value + (new[0] - start if moves else 0):
            return
    stretches.append(new)


def mapped(stretches: Sequence[Stretch], credit: int) -> int:
    """The value of a block's function."""
    start, value, moves = stretches[bisect_right([s[0] for s in stretches], credit) - 1]
    return value + (credit - start if moves else 0)


def limit_requests(
    requests: DataFrame, bucket: Bucket, key: str = "user_id", request: str = "event_id",
    parts: int | None = None,
) -> DataFrame:
    """Add ``allowed`` to a log of (key, ts, request, counts).

    The requests that count are sorted by key and time into ranges, ``parts`` of them if
    given, which cut a client of any size.  A range that may begin inside a client sums up
    its share of that client as a function from credit to credit; these few numbers per range
    give the credit with which every range begins, and then all ranges decide on their own.
    So a client that never pauses is spread like all others.  Keys must not be NULL.
    """
    credit = Credit.of(bucket)
    slim = requests.filter("counts").select(
        F.col(key).alias("owner"), F.unix_micros("ts").alias("at"), F.col(request).alias("request")
    )
    order = ["owner", "at", "request"]
    ranged = slim.repartitionByRange(parts, *order) if parts else slim.repartitionByRange(*order)
    # the ranges are kept, since a range sort cuts anew each time it runs
    ranges = written(ranged.withColumn("part", F.spark_partition_id()), "requests")
    in_order = ranges.repartition(*([parts] if parts else []), "part").sortWithinPartitions("part", *order)
    owner = dict(slim.dtypes)["owner"]
    sums = written(
        in_order.select("part", "owner", "at").mapInPandas(
            partial(_sums, credit),
            f"owner {owner}, part int, first bigint, last bigint, ends string, map array<struct<start:string,value:string,moves:boolean>>",
        ),
        "sums",
    )
    starts = sums.groupBy("owner").applyInPandas(
        partial(_starts, credit), f"part int, owner {owner}, credit string, last string"
    )
    # one row per range at most: its first client goes on from an earlier range
    begun = starts.select(F.col("part").alias("in_part"), F.col("owner").alias("in_owner"), "credit", "last")
    first = ranges.groupBy("part").agg(F.min("owner").alias("owner"))
    known = first.join(begun, (F.col("part") == F.col("in_part")) & (F.col("owner") == F.col("in_owner")), "left")
    known = F.broadcast(known.select(F.col("part").alias("of_part"), F.col("owner").alias("of_owner"), "credit", "last"))
    with_start = ranges.join(
        known, (F.col("part") == F.col("of_part")) & (F.col("owner") == F.col("of_owner")), "left"
    ).drop("of_part", "of_owner")
    decided = with_start.repartition(*([parts] if parts else []), "part").sortWithinPartitions("part", *order).mapInPandas(
        partial(_flags, credit), f"request {dict(slim.dtypes)['request']}, allowed boolean"
    ).withColumnRenamed("request", request)
    return requests.join(decided, request, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def _stretches_of_clients(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, object, bool, pd.DataFrame]]:
    """(part, owner, whether the client is the first of its part, rows), in order, batch by batch."""
    part = first = None
    for batch in batches:
        changes = (batch["part"] != batch["part"].shift()) | (batch["owner"] != batch["owner"].shift())
        edges = [*np.flatnonzero(changes.to_numpy()), len(batch)]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            rows = batch.iloc[begin:end]
            now, owner = int(rows["part"].iloc[0]), rows["owner"].iloc[0]
            if now != part:
                part, first = now, owner
            yield part, owner, owner == first, rows


def _sums(credit: Credit, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each range: its first client as a function, and its last one's credit if it began there."""
    held: dict | None = None
    found: list[dict] = []

    def close() -> None:
        if held and held["maps"]:
            whole = block_map([], credit)
            for stretches in held["maps"]:
                whole = composed(whole, stretches)
            cells = [{"start": str(a), "value": str(v), "moves": m} for a, v, m in whole]
            found.append(held["row"] | {"ends": None, "map": cells})
        elif held:
            found.append(held["row"] | {"ends": str(held["credit"]), "map": []})

    for part, owner, opens, rows in _stretches_of_clients(batches):
        times = rows["at"].tolist()
        if held is None or (held["row"]["part"], held["row"]["owner"]) != (part, owner):
            # only the first and the last client of a range can go on beyond it
            if held and (held["maps"] or held["row"]["part"] != part):
                close()
            row = {"owner": owner, "part": part, "first": times[0], "last": times[0]}
            held = {"row": row, "maps": [], "credit": credit.full, "before": None}
        if opens:
            # the gap to the batch before belongs to the block
            earlier = [] if not held["maps"] else [held["row"]["last"]]
            held["maps"].append(_gap_map(earlier, times, credit))
        else:
            _, held["credit"] = credit.decided(times, held["credit"], held["before"])
            held["before"] = times[-1]
        held["row"]["last"] = times[-1]
    close()
    names = ["owner", "part", "first", "last", "ends", "map"]
    yield pd.DataFrame([[r[n] for n in names] for r in found], columns=names)


def _gap_map(earlier: list[int], times: list[int], credit: Credit) -> list[Stretch]:
    """As :func:`block_map`, with the refill since the ``earlier`` request, if any."""
    own = block_map(times, credit)
    if not earlier:
        return own
    gained = (times[0] - earlier[0]) * credit.per_microsecond
    top = max(0, credit.full - gained)
    refill: list[Stretch] = [(0, min(gained, credit.full), gained < credit.full)]
    if 0 < top <= credit.full:
        _append(refill, (top, credit.full, False))
    return composed(refill, own)


def composed(first: Sequence[Stretch], second: Sequence[Stretch]) -> list[Stretch]:
    """``second`` after ``first``."""
    out: list[Stretch] = []
    starts = [s[0] for s in second]
    for k, (start, value, moves) in enumerate(first):
        if not moves:
            _append(out, (start, mapped(second, value), False))
            continue
        end = first[k + 1][0] if k + 1 < len(first) else None
        at = bisect_right(starts, value) - 1
        while at < len(second):
            begin = max(start, start + starts[at] - value)
            if end is not None and begin >= end:
                break
            s, v, m = second[at]
            _append(out, (begin, v + (value + begin - start - s if m else 0), m))
            at += 1
    return out


def _starts(credit: Credit, rows: pd.DataFrame) -> pd.DataFrame:
    """Credit and time before each range in which a client goes on; a few rows per range."""
    out = []
    now, last = None, None
    for row in rows.sort_values("part").itertuples(index=False):
        if len(row.map):
            at = credit.full
            if last is not None:
                out.append((row.part, row.owner, str(now), str(last)))
                at = min(credit.full, now + (row.first - last) * credit.per_microsecond)
            now = mapped([(int(c["start"]), int(c["value"]), bool(c["moves"])) for c in row.map], at)
        else:
            now = int(row.ends)
        last = row.last
    return pd.DataFrame(out, columns=["part", "owner", "credit", "last"])


def _flags(credit: Credit, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, now, last = None, credit.full, None
    for part, owner, _, rows in _stretches_of_clients(batches):
        if (part, owner) != current:
            current = part, owner
            begun = rows["credit"].iloc[0]
            goes_on = begun is not None and not pd.isna(begun)
            now, last = (int(begun), int(rows["last"].iloc[0])) if goes_on else (credit.full, None)
        times = rows["at"].tolist()
        flags, now = credit.decided(times, now, last)
        last = times[-1]
        yield pd.DataFrame({"request": rows["request"].to_numpy(), "allowed": flags})


def limit_stream(
    requests: DataFrame,
    bucket: Bucket,
    key: str = "user_id",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Stream of requests with ``allowed``, tokens and last refill kept per key.

    Requests are decided as they arrive, micro-batch by micro-batch, and inside one
    in (ts, event_id) order.  There is no watermark, so no request is ever late: one
    that is older than the last of its key finds no time passed.  A key's state is two
    numbers and is kept for good.
    """
    columns = [key, "ts", "event_id", "counts", *carry]
    types = dict(requests.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", allowed boolean"
    credit = Credit.of(bucket)

    def run(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        chunks = list(batches)
        # only time, id and the flag of all chunks are brought in order together
        part = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        times = np.concatenate([c["ts"].astype("datetime64[us]").astype("int64").to_numpy() for c in chunks])
        counts = np.concatenate([c["counts"].to_numpy() for c in chunks]).astype(bool)
        order = np.lexsort((np.concatenate([c["event_id"].to_numpy() for c in chunks]), times))
        takes = order[counts[order]]
        now, last = (int(state.get[0]), state.get[1]) if state.exists else (credit.full, None)
        flags, now = credit.decided(times[takes].tolist(), now, last)
        if len(takes):
            state.update((str(now), int(times[takes[-1]])))
        allowed = np.ones(len(order), bool)
        allowed[takes] = flags
        for i, chunk in enumerate(chunks):
            yield chunk.assign(allowed=allowed[part == i])[[*columns, "allowed"]]

    return (
        requests.select(*columns)
        .groupBy(key)
        .applyInPandasWithState(
            run, schema, "credit string, last bigint", "append", GroupStateTimeout.NoTimeout
        )
    )
