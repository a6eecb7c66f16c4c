"""Request counters and a cumulative latency histogram, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency buckets in seconds; the last is open.
LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, float("inf"))


def bound_label(bound: float) -> str:
    return "+Inf" if bound == float("inf") else str(bound)


def status_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def latency_totals(requests: DataFrame, latency: Column) -> DataFrame:
    """One row: every cumulative bucket, the sum and the count, in one aggregation.

    A request is counted once per bound by a conditional count, not copied.
    """
    counts = [
        F.count_if(latency <= bound).alias(f"le_{i}") for i, bound in enumerate(LATENCY_BOUNDS)
    ]
    return requests.groupBy().agg(
        *counts,
        F.coalesce(F.sum(latency), F.lit(0.0)).alias("latency_sum"),
        F.count(F.lit(1)).alias("latency_count"),
    )


def histogram_rows(totals: DataFrame) -> DataFrame:
    """(le, n) rows of :func:`latency_totals`."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(bound_label(b)).alias("le"),
                     F.col(f"le_{i}").alias("n"))
            for i, b in enumerate(LATENCY_BOUNDS)
        ]
    )
    return totals.select(F.inline(cells))


def exposition_lines(counts: DataFrame, totals: DataFrame, prefix: str = "service") -> DataFrame:
    """The metrics as text lines with their order: (position, key, line)."""
    status = counts.select(
        F.lit(0).alias("position"), F.col("status").alias("key"),
        F.format_string(f'{prefix}_requests_total{{status="%s"}} %d', "status", "n").alias("line"),
    )
    buckets = histogram_rows(totals).select(
        (F.col("position") + 1).alias("position"), F.col("le").alias("key"),
        F.format_string(f'{prefix}_latency_seconds_bucket{{le="%s"}} %d', "le", "n").alias("line"),
    )
    last = len(LATENCY_BOUNDS) + 1
    count = totals.select(
        F.lit(last).alias("position"), F.lit("count").alias("key"),
        F.format_string(f"{prefix}_latency_seconds_count %d", "latency_count").alias("line"),
    )
    return status.unionByName(buckets).unionByName(count)
