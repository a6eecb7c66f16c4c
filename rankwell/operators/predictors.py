"""Named predictors over a table of cases, and the choice between two of them.

A predictor is a function DataFrame -> Column giving
``struct<time, space, certainty, engine, error>``.  It never fails a job: what
goes wrong for a row is the row's ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREDICTION = "struct<time:string,space:string,certainty:string,engine:string,error:string>"
Predictor = Callable[[DataFrame], Column]

_registry: dict[str, Predictor] = {}


def register_predictor(name: str, predictor: Predictor) -> None:
    _registry[name] = predictor


def available_predictors() -> list[str]:
    return sorted(_registry)


def get_predictor(name: str) -> Predictor:
    if name not in _registry:
        raise KeyError(f"unknown predictor {name!r}; known: {available_predictors()}")
    return _registry[name]


def prediction(
    time: Column, space: Column, engine: str, certainty: Column | None = None,
    error: Column | None = None,
) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        time.alias("time"),
        space.alias("space"),
        (none if certainty is None else certainty).alias("certainty"),
        F.lit(engine).alias("engine"),
        (none if error is None else error).alias("error"),
    )


def model_predictor(
    engine: str, model: Callable[[pd.DataFrame], pd.DataFrame], inputs: Sequence[str]
) -> Predictor:
    """Wrap a user's batch model (frame in, frame with time and space out).

    Runs in Arrow batches.  When a batch fails, its rows are tried one by one and
    only the rows at fault carry an error.
    """
    names = list(inputs)

    @F.pandas_udf(PREDICTION)
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch.columns = names
        out = pd.DataFrame(
            {"time": None, "space": None, "certainty": None, "engine": engine, "error": None},
            index=batch.index,
            dtype=object,
        )
        todo = [(0, len(batch))]
        while todo:  # halve a failing stretch until the rows at fault stand alone
            start, stop = todo.pop()
            if start == stop:
                continue
            try:
                got = model(batch.iloc[start:stop])
                out.iloc[start:stop, 0] = got["time"].to_numpy(dtype=object)
                out.iloc[start:stop, 1] = got["space"].to_numpy(dtype=object)
            except Exception as error:
                if stop - start == 1:
                    out.iloc[start, 4] = f"{type(error).__name__}: {error}"
                else:
                    middle = (start + stop) // 2
                    todo += [(start, middle), (middle, stop)]
        return out

    return lambda frame: run(F.struct(*names))


def predict_all(cases: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Answers of several predictors in one pass, in long form."""
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("predictor"), get_predictor(n)(cases).alias("prediction"))
            for n in names
        ]
    )
    return cases.select(*keep, F.inline(cells)).select(*keep, "predictor", "prediction.*")


# The warnings of the hybrid answer.
FALLBACK_WARNING = (
    "the symbolic engine could not bound this code ({}); the answer below comes "
    "from the ML fallback model, which is less reliable"
)
UNKNOWN_WARNING = (
    "a large share of parsed nodes were unmapped (UNKNOWN) -- predictions may be unreliable"
)


def hybrid(cases: DataFrame, mode: str = "hybrid", dimensions: Sequence[str] = ("time", "space")) -> DataFrame:
    """Primary answer unless missing, failed or unknown; then the fallback with a warning.

    ``cases`` carries ``primary_*``, ``fallback_*``, ``certainty``,
    ``primary_error`` and optionally ``unknown_share_high``.  Mode ``ml`` skips
    the primary.
    """
    if mode not in ("hybrid", "ml"):
        raise ValueError(f"unknown prediction mode {mode!r}; known: ['hybrid', 'ml']")
    served = (
        F.lit(mode == "hybrid")
        & F.col("primary_error").isNull()
        & F.col("certainty").isNotNull()
        & (F.col("certainty") != "unknown")
    )
    reason = F.coalesce("primary_error", F.lit("no cost bound could be derived"))
    fallback = F.when(
        ~served & F.lit(mode == "hybrid"), F.format_string(FALLBACK_WARNING.replace("{}", "%s"), reason)
    )
    shaky = (
        F.when(F.col("unknown_share_high"), UNKNOWN_WARNING)
        if "unknown_share_high" in cases.columns
        else F.lit(None).cast("string")
    )
    engine = F.when(served, "symbolic").otherwise("ml_fallback" if mode == "hybrid" else "ml")
    answers = [
        F.when(served, F.col(f"primary_{d}")).otherwise(F.col(f"fallback_{d}")).alias(f"answer_{d}")
        for d in dimensions
    ]
    return cases.select(
        "case_id", engine.alias("engine"), *answers,
        F.array_compact(F.array(shaky, fallback)).alias("warnings"),
    )
