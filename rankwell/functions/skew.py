"""Building blocks that stay parallel when one key holds a large share of all rows.

A plain window over a hot key puts that key in one task.  Each function here
first works inside narrower pieces of a group, then combines one small row per
piece, so the largest task is bounded by the piece and not by the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces a hot group is cut into before its best rows are ranked.
SALTS = 64


def keep_lowest(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    salts: int = SALTS,
    row_id: str | None = None,
) -> DataFrame:
    """The first ``limit`` rows of every group in the given total order.

    Ranked twice: within (group, salt), then within the group over at most
    ``salts * limit`` survivors.  Catalyst adds a map-side group limit to both.

    With a unique ``row_id`` only the keys and the order are ranked and the wide
    rows are picked by a semi-join on that id.  Reducers chained on one id
    shuffle the wide rows once in all, because the partitioning stays.
    """
    if row_id is not None:
        chosen = lowest_ids(frame, keys, order, limit, row_id, salts)
        return frame.join(chosen, row_id, "left_semi")
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        frame.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(inner))
        .filter(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(outer))
        .filter(F.col("_rank") <= limit)
        .drop("_salt", "_rank")
    )


def lowest_ids(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    row_id: str,
    salts: int = SALTS,
) -> DataFrame:
    """The ids of the rows :func:`keep_lowest` keeps, ranked on narrow rows."""
    names = [f"_o{i}" for i in range(len(order))]
    slim = frame.select(
        F.col(row_id),
        *[F.col(k) for k in keys if k != row_id],
        *[o.alias(n) for o, n in zip(order, names, strict=True)],
    )
    return keep_lowest(slim, keys, [F.col(n) for n in names], limit, salts).select(row_id)


def keep_lowest_counted(
    frame: DataFrame,
    keys: Sequence[str],
    number: Column,
    tie: Sequence[Column],
    limit: int,
    width: int = 1024,
) -> DataFrame:
    """The first ``limit`` rows of every group by ``number``, a whole number, then ``tie``.

    For limits of any size: rows are counted per range of ``width`` numbers, then per
    number in the range with the cut, and all rows below the cut's number stay unranked.
    Only rows of that one number are ranked.  A group's ranges, and the numbers of one
    range, are counted on the map side and are few.  Keys may be NULL.  The frame is read
    several times, so it should be a stored, narrow table.
    """
    placed = frame.withColumn("_number", number.cast("bigint"))
    ranged = placed.withColumn("_range", F.floor(F.col("_number") / width).cast("bigint"))

    def cuts(counted: DataFrame, at: str, before: Column) -> DataFrame:
        """Per group the first ``at`` that reaches the limit, and the rows before it."""
        upto = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counted.withColumn("_upto", F.sum("_c").over(upto) + before)
        return summed.filter((F.col("_upto") >= limit) & (F.col("_upto") - F.col("_c") < limit)).select(
            *keys, F.col(at).alias(f"{at}_cut"), (F.col("_upto") - F.col("_c")).alias(f"{at}_before")
        )

    count = F.count(F.lit(1)).alias("_c")
    coarse = cuts(ranged.groupBy(*keys, "_range").agg(count), "_range", F.lit(0))
    inside = _join(ranged.select(*keys, "_range", "_number"), coarse, keys).filter(
        F.col("_range") == F.col("_range_cut")
    )
    fine = cuts(inside.groupBy(*keys, "_range_before", "_number").agg(count), "_number", F.col("_range_before"))
    joined = _join(placed, fine, keys, "left")
    # groups without a cut have fewer rows than the limit
    below = joined.filter(F.col("_number_cut").isNull() | (F.col("_number") < F.col("_number_cut")))
    ranks = Window.partitionBy(*keys).orderBy(*tie)
    at_cut = joined.filter(F.col("_number") == F.col("_number_cut")).withColumn(
        "_rank", F.row_number().over(ranks) + F.col("_number_before")
    )
    kept = below.unionByName(at_cut.filter(F.col("_rank") <= limit).drop("_rank"))
    return kept.drop("_number", "_number_cut", "_number_before")


def running_total(
    frame: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[Column],
    order: Sequence[Column],
    weight: Column,
    name: str = "running",
) -> DataFrame:
    """Inclusive running sum of ``weight`` per group, exact for any group size.

    ``blocks`` cut a group from coarse to fine into runs that are contiguous in
    ``order``.  Sums are taken per finest block, offsets are accumulated level by
    level, and only rows of one finest block share a task.  The wide rows are
    shuffled once: the lookup of the offsets uses the same partitioning.  Keys
    must not be NULL.
    """
    names = [f"_b{i}" for i in range(len(blocks))]
    cut = frame.select("*", *[b.alias(n) for n, b in zip(names, blocks, strict=True)])
    cut = cut.withColumn("_w", weight)
    sums = cut.groupBy(*keys, *names).agg(F.sum("_w").alias("_sum"))
    offsets: DataFrame | None = None
    for level in range(len(names)):
        upper, here = names[:level], names[level]
        totals = sums.groupBy(*keys, *upper, here).agg(F.sum("_sum").alias("_t"))
        window = (
            Window.partitionBy(*keys, *upper).orderBy(here)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        local = totals.select(
            *keys, *upper, here,
            F.coalesce(F.sum("_t").over(window), F.lit(0)).alias("_o"),
        )
        if offsets is None:
            offsets = local
        else:
            parent = offsets.withColumnRenamed("_o", "_p")
            offsets = local.join(parent, [*keys, *upper]).select(
                *keys, *upper, here, (F.col("_o") + F.col("_p")).alias("_o")
            )
    inner = (
        Window.partitionBy(*keys, *names).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = cut.withColumn("_in", F.sum("_w").over(inner))
    joined = summed.join(offsets, [*keys, *names], "left")
    return joined.withColumn(name, F.col("_in") + F.col("_o")).drop(*names, "_w", "_in", "_o")


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") for c in on],
        *[c for c in right.columns if c not in on],
    )
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def next_in_group(
    frame: DataFrame, keys: Sequence[str], position: str, block: Column, name: str = "next"
) -> DataFrame:
    """The following ``position`` of the same group, NULL at its end.

    Inside a block by ``lead``; the last row of a block takes the first position
    of the next block, looked up in a table of one row per block.  Keys must not
    be NULL.
    """
    cut = frame.withColumn("_block", block)
    firsts = cut.groupBy(*keys, "_block").agg(F.min(position).alias("_first"))
    following = firsts.select(
        *keys, "_block",
        F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_after"),
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(position)
    led = cut.withColumn("_lead", F.lead(position).over(inner))
    return (
        led.join(following, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_lead", "_after"))
        .drop("_block", "_lead", "_after")
    )


def value_at_ranks(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Sequence[tuple[str, Column]],
    steps: int = 1000,
) -> DataFrame:
    """Exact order statistics per group: the value at given 1-based ranks.

    ``ranks`` maps an output name to a rank expression over the group size ``_n``.
    Approximate quantiles of the group, ``steps`` of them, bracket every wanted rank:
    a bracket holds about three steps of the group's rows, however its values are
    spread.  Rows below a bracket are counted, rows inside are counted by value, and
    only those values are ranked.
    """
    if not keys:
        # a key that does not fold away, so the bracket table is joined by it
        keyed = frame.withColumn("_all", F.hash(value).bitwiseAND(F.lit(0)))
        return value_at_ranks(keyed, ["_all"], value, ranks, steps).drop("_all")
    grid = [i / steps for i in range(steps + 1)]
    sizes = frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, grid, 10 * steps).alias("_grid")
    )

    def bracket(name: str, rank: Column) -> Column:
        at = (rank * steps / F.col("_n")).cast("int")
        low = F.when(at >= 2, F.get("_grid", at - 2))
        high = F.when(at + 2 <= steps, F.get("_grid", at + 2))
        return F.struct(F.lit(name).alias("name"), rank.alias("rank"), low.alias("low"), high.alias("high"))

    brackets = sizes.select(
        *keys, "_n", F.array(*[bracket(name, rank) for name, rank in ranks]).alias("_b")
    )
    rows = _join(frame.select(*keys, value), brackets, keys)
    # One evaluation of the brackets decides for every row: approximate quantiles differ from
    # run to run, so counts below and inside must not come from two of them.  Rows below are
    # counted under NULL, which comes first in the order.
    low = F.col("_t.low")
    cell = F.when(low.isNull() | (F.col(value) >= low), F.col(value))
    counted = (
        rows.filter(F.col(value).isNotNull())
        .select(
            *keys, "_n", value,
            F.explode(F.filter("_b", lambda t: t["high"].isNull() | (F.col(value) <= t["high"]))).alias("_t"),
        )
        .groupBy(*keys, F.col("_t.name").alias("_name"), cell.alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_t.rank").alias("_rank"), F.first("_n").alias("_n"))
    )
    order = Window.partitionBy(*keys, "_name").orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    upto = F.sum("_c").over(order)
    placed = counted.select(
        *keys, "_n", "_name", "_cell",
        ((upto - F.col("_c") < F.col("_rank")) & (upto >= F.col("_rank"))).alias("_here"),
    )
    return placed.groupBy(*keys).agg(
        F.first("_n").alias("n"),
        *[F.max(F.when(F.col("_here") & (F.col("_name") == name), F.col("_cell"))).alias(name) for name, _ in ranks],
    )


def numbered(frame: DataFrame, file: str, start: str, name: str = "row_index") -> DataFrame:
    """Zero-based position of each row over all files, in the order of their names.

    ``file`` and ``start`` are columns with ``_metadata.file_path`` and
    ``_metadata.file_block_start``; they are dropped.  One narrow pass counts the rows
    of each file split; their running sums (one row per split) are the offsets, however
    Spark packs splits into tasks.  The scan must be repeatable, as a file scan is.
    """
    placed = frame.withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    splits = placed.groupBy(file, start).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first")
    )
    before = Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        F.col(file).alias("_f"), F.col(start).alias("_s"),
        (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_off"),
    )
    # one row per split of the scan, so the broadcast is bounded by the task count
    return (
        placed.join(F.broadcast(offsets), (F.col(file) == F.col("_f")) & (F.col(start) == F.col("_s")))
        .withColumn(name, F.col("_at") + F.col("_off"))
        .drop("_f", "_s", "_at", "_off", file, start)
    )


def lowest_hash(
    frame: DataFrame,
    bucket: str,
    tie: Sequence[str],
    limit: int | Column,
    ranges: int = 4096,
    width_bits: int = 48,
) -> DataFrame:
    """The ``limit`` rows with the lowest hash of the whole table.

    The hash is uniform, so fixed ranges of it hold about equally many rows.  A
    narrow pass counts the ranges; the rank of a row is the count of lower ranges
    plus its place in its own.  No single task sees the whole sample.
    ``limit`` may be a scalar subquery.
    """
    width = (1 << width_bits) // ranges
    ranged = frame.withColumn("_range", F.floor(F.col(bucket) / width).cast("bigint"))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")
    )
    # at most `ranges` rows, so the broadcast has a fixed bound
    limited = ranged.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    limited = limited.filter(F.col("_off") < limit)
    window = Window.partitionBy("_range").orderBy(bucket, *tie)
    return (
        limited.withColumn("_rank", F.row_number().over(window) + F.col("_off"))
        .filter(F.col("_rank") <= limit)
        .drop("_range", "_r", "_off", "_rank")
    )


def lowest_hash_per_group(
    frame: DataFrame,
    group: str,
    quota: DataFrame,
    bucket: str,
    tie: Sequence[str],
    ranges: int = 4096,
    width_bits: int = 48,
) -> DataFrame:
    """As :func:`lowest_hash`, with a quota per group.

    ``quota`` has columns (``group``, ``quota``) and is written by hand, one row
    per named group; groups it does not name are left out.
    """
    width = (1 << width_bits) // ranges
    ranged = frame.withColumn("_range", F.floor(F.col(bucket) / width).cast("bigint")).join(
        F.broadcast(quota), group
    )
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = (
        Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        F.col(group).alias("_g"),
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
    )
    # at most `ranges` rows per named group
    limited = ranged.join(
        F.broadcast(offsets), (F.col(group) == F.col("_g")) & (F.col("_range") == F.col("_r"))
    ).filter(F.col("_off") < F.col("quota"))
    window = Window.partitionBy(group, "_range").orderBy(bucket, *tie)
    return (
        limited.withColumn("_rank", F.row_number().over(window) + F.col("_off"))
        .filter(F.col("_rank") <= F.col("quota"))
        .drop("_range", "_g", "_r", "_off", "_rank", "quota")
    )
