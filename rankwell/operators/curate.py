"""Curating a labelled corpus: dedupe, caps, samples and slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.functions.hashing import (
    ORDER_MODULUS,
    record_key,
    split_name,
    stable_bucket,
    wide_bucket,
)
from rankwell.functions.skew import (
    keep_lowest,
    keep_lowest_counted,
    lowest_hash,
    lowest_hash_per_group,
    lowest_ids,
)
from rankwell.session import written

PROBLEM = ("source", "problem_id")


def map_labels(
    frame: DataFrame,
    raw: str,
    vocabulary: Column,
    table: Mapping[str, Mapping[str, str]],
    out: str,
    strict: bool = False,
) -> DataFrame:
    """Add ``out`` (the class) and ``out_status``: ok, null, unknown_source or unmapped.

    The vocabulary is a constant map of maps written by hand, so this is a
    projection.  ``strict`` raises on the first label that has no class.
    """
    lookup = F.create_map(
        *[
            x
            for name, pairs in table.items()
            for x in (
                F.lit(name),
                F.map_from_arrays(
                    F.array(*map(F.lit, pairs.keys())), F.array(*map(F.lit, pairs.values()))
                ),
            )
        ]
    )
    words = F.element_at(lookup, vocabulary)
    mapped = F.element_at(words, F.col(raw))
    status = (
        F.when(F.col(raw).isNull(), "null")
        .when(words.isNull(), "unknown_source")
        .when(mapped.isNull(), "unmapped")
        .otherwise("ok")
    )
    if strict:
        message = F.concat(F.lit(f"{raw}: no class for label "), F.col(raw))
        mapped = F.when(status.isin("unknown_source", "unmapped"), F.raise_error(message)).otherwise(
            mapped
        )
    return frame.withColumn(out, mapped).withColumn(f"{out}_status", status)


def with_label(frame: DataFrame, label: str) -> DataFrame:
    """Rows that carry a label in this dimension."""
    return frame.filter(F.col(label).isNotNull())


def usable(entries: DataFrame, kind: str) -> DataFrame:
    """Audit entries of one kind whose reading was not of low confidence."""
    return entries.filter((F.col("kind") == kind) & (F.col("confidence") != "low"))


def in_languages(frame: DataFrame, languages: Sequence[str]) -> DataFrame:
    return frame.filter(F.col("language").isin(*languages))


def exact_dedupe(frame: DataFrame, position: str = "input_pos") -> DataFrame:
    """First row in input order of every (source, code).

    Texts are compared by their sha256.  Hashes and positions decide; the texts
    themselves only follow the positions that were kept.  ``position`` is unique.
    """
    keyed = frame.withColumn("_code", F.sha2("code", 256))
    chosen = lowest_ids(keyed, ["source", "_code"], [F.col(position)], 1, position)
    return frame.join(chosen, position, "left_semi")


def hash_order(key: Column | None = None) -> list[Column]:
    """Lowest hash first; the key itself breaks ties."""
    key = record_key() if key is None else key
    return [stable_bucket(key, ORDER_MODULUS), key]


def _id_in(frame: DataFrame, row_id: str | None) -> str | None:
    return row_id if row_id in frame.columns else None


def structure_dedupe(
    frame: DataFrame, keep: int = 1, signature: str = "signature", row_id: str | None = "input_pos"
) -> DataFrame:
    """At most ``keep`` rows per problem, signature and labels; no signature keeps the row."""
    unsigned = frame.filter(F.col(signature).isNull())
    signed = frame.filter(F.col(signature).isNotNull())
    groups = [*PROBLEM, signature, "time_class", "space_class"]
    row_id = _id_in(frame, row_id)
    if row_id is None:
        return keep_lowest(signed, groups, hash_order(), keep).unionByName(unsigned)
    chosen = lowest_ids(signed, groups, hash_order(), keep, row_id)
    return frame.join(chosen.unionByName(unsigned.select(row_id)), row_id, "left_semi")


def cap_per_problem(
    frame: DataFrame, limit: int, row_id: str | None = "input_pos"
) -> DataFrame:
    return keep_lowest(
        frame, list(PROBLEM), hash_order(), limit, row_id=_id_in(frame, row_id)
    )


def cap_per_class(
    frame: DataFrame, limit: int, label: str = "time_class", row_id: str | None = "input_pos"
) -> DataFrame:
    """Cap every class; rows without a label form a class of their own.

    Classes are few and their caps large, so rows are counted up to the cut, not ranked.
    """
    row_id = _id_in(frame, row_id)
    number, key = hash_order()
    if row_id is None:
        return keep_lowest_counted(written(frame, "classes"), [label], number, [key], limit)
    slim = written(frame.select(row_id, label, number.alias("_hash"), key.alias("_key")), "classes")
    chosen = keep_lowest_counted(slim, [label], F.col("_hash"), [F.col("_key")], limit)
    return frame.join(chosen.select(row_id), row_id, "left_semi")


def decision_table(records: DataFrame, columns: Sequence[str] = (), position: str = "input_pos") -> DataFrame:
    """What the reducers decide on, written once: id, keys, labels and the text's hash."""
    chosen = [position, "source", *PROBLEM, "solution_id", "time_class", "space_class", *columns]
    return written(
        records.select(*dict.fromkeys(chosen), F.sha2("code", 256).alias("code_hash")), "decisions"
    )


def first_of_code(decisions: DataFrame, position: str = "input_pos") -> DataFrame:
    """As :func:`exact_dedupe`, on a decision table."""
    return keep_lowest(decisions, ["source", "code_hash"], [F.col(position)], 1)


def with_split(frame: DataFrame, train_frac: float = 0.70, val_frac: float = 0.15) -> DataFrame:
    return frame.withColumn("split", split_name(train_frac, val_frac))


def hash_sample(frame: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows with the lowest 48-bit hash."""
    hashed = frame.withColumn("bucket", wide_bucket(record_key()))
    return lowest_hash(hashed, "bucket", ["source", "solution_id"], F.lit(size))


def hash_sample_per_language(frame: DataFrame, quotas: Mapping[str, int]) -> DataFrame:
    """A quota of lowest-hash labelled rows for each named language."""
    spark = frame.sparkSession
    quota = spark.createDataFrame(list(quotas.items()), "language string, quota long")
    labelled = frame.filter(F.col("time_class").isNotNull() | F.col("space_class").isNotNull())
    hashed = labelled.withColumn("bucket", wide_bucket(record_key()))
    return lowest_hash_per_group(
        hashed, "language", quota, "bucket", ["source", "solution_id"]
    )


def quota_fill(frame: DataFrame, rows: int, majority: str) -> DataFrame:
    """Every row of the other languages, the majority language filling up to ``rows``."""
    hashed = frame.withColumn("bucket", wide_bucket(record_key()))
    others = hashed.filter(F.col("language") != majority)
    room = others.agg(F.greatest(F.lit(0), F.lit(rows) - F.count(F.lit(1)))).scalar()
    major = hashed.filter(F.col("language") == majority)
    filled = lowest_hash(major, "bucket", ["source", "solution_id"], room)
    return others.unionByName(filled)


def blind_sample(frame: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows with both labels, and the same rows without them."""
    both = frame.filter(F.col("time_class").isNotNull() & F.col("space_class").isNotNull())
    chosen = hash_sample(both, size)
    return chosen, chosen.drop("time_class", "space_class")


def known_classes_only(frame: DataFrame, trained: DataFrame, label: str) -> DataFrame:
    """Drop rows whose label never occurs in ``trained``."""
    seen = trained.filter(F.col(label).isNotNull()).select(label).distinct()
    return frame.join(seen, label, "left_semi")


def language_by_fewest_errors(counts: DataFrame, key: str) -> DataFrame:
    """Per record the language with the fewest errors, ties to the first name."""
    return counts.groupBy(key).agg(
        F.min_by("language", F.struct("errors", "language")).alias("language"),
        F.min("errors").alias("errors"),
    )
