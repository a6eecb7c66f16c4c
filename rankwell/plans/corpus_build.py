"""The corpus build: reducers in their fixed order, then the split by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankwell.operators.curate import (
    cap_per_class,
    cap_per_problem,
    decision_table,
    first_of_code,
    structure_dedupe,
    with_split,
)


def build_corpus(
    records: DataFrame,
    *,
    dedupe_structure: bool = False,
    max_per_problem: int | None = None,
    max_per_class: int | None = None,
    train_frac: float = 0.70,
    val_frac: float = 0.15,
) -> DataFrame:
    """Exact dedupe, then the optional reducers, then the split column.

    The order is part of the result.  All reducers decide on one narrow table, which is
    written once, so ``records`` are read twice: for that table, and for the rows that
    stay.  Their ``input_pos`` is unique and the same in both reads.  Structure dedupe needs a ``signature``
    column; see :func:`rankwell.operators.graph.structure_signature`.
    """
    decisions = decision_table(records, ["signature"] if dedupe_structure else [])
    kept = first_of_code(decisions)
    if dedupe_structure:
        kept = structure_dedupe(kept, row_id=None)
    if max_per_problem is not None:
        kept = cap_per_problem(kept, max_per_problem, row_id=None)
    if max_per_class is not None:
        kept = cap_per_class(kept, max_per_class, row_id=None)
    chosen = records.join(kept.select("input_pos"), "input_pos", "left_semi")
    return with_split(chosen, train_frac, val_frac)
