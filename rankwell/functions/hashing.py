"""Deterministic hash buckets.  The same key gives the same bucket on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus used where rows of one group are put in hash order.
ORDER_MODULUS = 1_000_003
#: Values of the 12-digit hash lie in [0, 2^48).
WIDE_BITS = 48


def stable_bucket(key: Column, buckets: int = 100) -> Column:
    """First 8 hex digits of sha256 of ``key``, modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def wide_bucket(key: Column) -> Column:
    """First 12 hex digits of sha256 of ``key`` as a 48-bit number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("bigint")


def record_key() -> Column:
    """The identity that hash order is taken over: ``source:solution_id``."""
    return F.concat_ws(":", "source", "solution_id")


def split_name(train_frac: float = 0.70, val_frac: float = 0.15) -> Column:
    """Train, val or test by the hash of ``source:problem_id``.

    All solutions of a problem fall on the same side, and no shuffle is needed.
    """
    train_cut = round(train_frac * 100)
    val_cut = train_cut + round(val_frac * 100)
    bucket = stable_bucket(F.concat_ws(":", "source", "problem_id"))
    return (
        F.when(bucket < train_cut, "train").when(bucket < val_cut, "val").otherwise("test")
    )
