"""Expanding records into variants, and measuring which answers survive them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.functions.skew import running_total
from rankwell.functions.stats import share
from rankwell.functions.variants import PAD_SIZES, add_filler, all_variants

#: (code, language) -> struct<time, space, error>
TextPredictor = Callable[[Column, Column], Column]


def expand_variants(
    frame: DataFrame, names: Sequence[str] | None = None
) -> DataFrame:
    """One row per record and applicable variant: ``variant`` and its ``text``."""
    chosen = None if names is None else list(names)
    pairs = all_variants(F.col("code"), F.col("language"), chosen)
    return frame.select("*", F.inline(pairs)).withColumnRenamed("name", "variant")


def pad_records(frame: DataFrame, *sizes: int, chosen: Column | None = None) -> DataFrame:
    """Padded copies with the id suffix ``+pad<k>``; unpaddable records are left out.

    With several sizes, ``chosen`` gives the size of each row.
    """
    size = F.lit(sizes[0]) if chosen is None else chosen
    padded = frame.withColumn(
        "code", add_filler(*sizes, chosen=chosen)(F.col("code"), F.col("language"))
    )
    return padded.filter(F.col("code").isNotNull()).withColumn(
        "solution_id", F.concat("solution_id", F.lit("+pad"), size)
    )


def dense_position(frame: DataFrame, position: str, name: str = "_place") -> DataFrame:
    """Zero-based rank of each row by a unique integer ``position``."""
    blocks = [F.shiftright(position, 24), F.shiftright(position, 12)]
    ranked = running_total(frame, [], blocks, [F.col(position)], F.lit(1), name=name)
    return ranked.withColumn(name, F.col(name) - 1)


def augment(
    frame: DataFrame, sizes: Sequence[int] = PAD_SIZES, position: str = "input_pos"
) -> DataFrame:
    """The records and one padded copy of each, the i-th row cycling through ``sizes``."""
    if not sizes:
        return frame
    placed = dense_position(frame, position)
    size = F.element_at(
        F.array(*map(F.lit, sizes)), (F.col("_place") % len(sizes) + 1).cast("int")
    )
    return frame.unionByName(pad_records(placed, *sizes, chosen=size).drop("_place"))


def twin_survival(
    answers: DataFrame, variant_answers: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Share of variants ``x+pad40`` that answer as their original ``x`` does."""
    original = answers.select(
        F.col("solution_id").alias("original"),
        F.col("time").alias("old_time"), F.col("space").alias("old_space"),
    )
    parts = F.split("solution_id", r"\+pad")
    twins = variant_answers.select(
        parts[0].alias("original"), parts[1].cast("int").alias("size"), "time", "space", *by
    )
    same = F.col("time").eqNullSafe(F.col("old_time")) & F.col("space").eqNullSafe(
        F.col("old_space")
    )
    return (
        twins.join(original, "original")
        .groupBy(*by, "size")
        .agg(F.count_if(same).alias("same"), F.count(F.lit(1)).alias("total"))
        .withColumn("unchanged_share", share(F.col("same"), F.col("total")))
    )


def padding_survival(
    frame: DataFrame,
    predictors: Mapping[str, TextPredictor],
    sizes: Sequence[int] = PAD_SIZES,
) -> DataFrame:
    """(predictor, size, same, total) of answers unchanged by padding.

    Answer before and after sit on one row, so nothing is joined.  Rows that
    cannot be padded, or had no answer to begin with, are skipped.
    """
    code, language = F.col("code"), F.col("language")
    padded = F.array(
        *[F.struct(F.lit(k).alias("size"), add_filler(k)(code, language).alias("text")) for k in sizes]
    )
    rows = frame.select("code", "language", F.inline(padded)).filter(F.col("text").isNotNull())
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("predictor"),
                predict(code, language).alias("before"),
                predict(F.col("text"), language).alias("after"),
            )
            for name, predict in predictors.items()
        ]
    )
    answered = rows.select("size", F.inline(cells)).filter(
        F.col("before.time").isNotNull() | F.col("before.space").isNotNull()
    )
    grid = frame.sparkSession.createDataFrame(
        [(n, k) for n in predictors for k in sizes], "predictor string, size int"
    )
    counted = answered.groupBy("predictor", "size").agg(
        F.count_if(_unchanged()).alias("same"), F.count(F.lit(1)).alias("total")
    )
    return grid.join(counted, ["predictor", "size"], "left").select(
        "predictor", "size",
        F.coalesce("same", F.lit(0)).alias("same"), F.coalesce("total", F.lit(0)).alias("total"),
    )


def _unchanged() -> Column:
    return F.col("after.time").eqNullSafe(F.col("before.time")) & F.col("after.space").eqNullSafe(
        F.col("before.space")
    )


def invariance_rows(
    frame: DataFrame, predict: TextPredictor, names: Sequence[str] | None = None
) -> DataFrame:
    """(solution_id, language, variant, same) for every applicable variant.

    A record whose own prediction fails is skipped; a failing variant is a flip.
    """
    code, language = F.col("code"), F.col("language")
    based = frame.withColumn("before", predict(code, language)).filter(
        F.col("before.error").isNull()
    )
    after = expand_variants(based, names).withColumn("after", predict(F.col("text"), language))
    same = F.col("after.error").isNull() & _unchanged()
    return after.select("solution_id", "language", "variant", same.alias("same"))


def invariance_report(rows: DataFrame) -> DataFrame:
    """Unchanged answers overall, by variant and by language; the rate of nothing is 1."""
    grouped = rows.groupingSets([[], ["variant"], ["language"]], "variant", "language").agg(
        F.grouping_id().alias("g"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("same").alias("unchanged"),
    )
    scope = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "variant").otherwise("language")
    return grouped.select(
        scope.alias("scope"),
        F.coalesce("variant", "language", F.lit("all")).alias("key"),
        "n", "unchanged",
        share(F.col("unchanged"), F.col("n"), empty=1.0).alias("rate"),
    )


def flips(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("same")).select("solution_id", "language", "variant")
