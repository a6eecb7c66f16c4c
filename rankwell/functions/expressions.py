"""Canonical spelling of growth expressions such as ``O(n log n)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brackets and separators inside a finished bracket group are swapped for
# private-use characters, so the next level sees the group as one word.
_PLAIN = "()+* "
_HIDDEN = "\ue000\ue001\ue002\ue003\ue004"
_INNERMOST = r"\([^()]*\)"


def _hide(text: Column) -> Column:
    return F.translate(text, _PLAIN, _HIDDEN)


def _show(text: Column) -> Column:
    return F.translate(text, _HIDDEN, _PLAIN)


def _flat(text: Column) -> Column:
    """Sort the factors of every term and the terms of a bracket-free sum."""

    def term(t: Column) -> Column:
        factors = F.filter(F.split(F.translate(t, "*", " "), " "), lambda f: f != "")
        return F.array_join(F.array_sort(F.transform(factors, _show)), "*")

    terms = F.filter(F.split(text, r"\+"), lambda t: F.trim(t) != "")
    return F.array_join(F.array_sort(F.transform(terms, term)), "+")


def _fold_innermost(text: Column) -> Column:
    """Replace every innermost bracket group by its hidden canonical form."""
    groups = F.regexp_extract_all(text, F.lit(_INNERMOST), 0)

    def rebuilt(parts: Column) -> Column:
        def folded(group: Column, i: Column) -> Column:
            before = F.get(parts, i)
            after = F.get(parts, i + 1)
            inner = F.substring(group, F.lit(2), F.length(group) - 2)
            # a power or an unknown function keeps its argument as written
            whole = before.rlike(r"(^|[ +*(])(log|sqrt)?$") & after.rlike(r"^($|[ +*)])")
            body = F.when(whole, _flat(inner)).otherwise(
                F.replace(_show(inner), F.lit(" "), F.lit(""))
            )
            return F.concat(_hide(F.concat(F.lit("("), body, F.lit(")"))), after)

        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(groups, folded), ""))

    return _bind(F.split(text, _INNERMOST, -1), rebuilt)


def _bind(text: Column, step) -> Column:
    """Apply ``step`` to a value computed once, not once per mention in the tree."""
    return F.element_at(F.transform(F.array(text), step), 1)


def normalize_expr(text: Column) -> Column:
    """Order and spacing of factors and terms do not matter; names, powers and logs do.

    Brackets may nest to any depth.  NULL when they do not match; see
    :func:`expr_rejected`.
    """
    return _bind(_folded(text), lambda t: F.when(~t.rlike("[()]"), _flat(t)))


def expr_rejected(text: Column) -> Column:
    return _folded(text).rlike("[()]")


#: Functions that may stand before their argument without brackets, as in ``log n``.
FUNCTIONS = ("log", "sqrt")
#: Words, runs of blanks, and single marks.
_PARTS = r"(?U)\w+|\s+|[^\w\s]"


def _applied(text: Column) -> Column:
    """Brackets around a name that follows a function after blanks.

    One walk over the parts remembers whether the last word was a function that has no
    argument yet, and holds the blanks behind it back until the next part is known.
    """

    def step(state: Column, part: Column) -> Column:
        waiting = state["function"]
        argument = waiting & (state["blanks"] != "") & F.rlike(part, F.lit(r"^[\p{L}_]"))
        holds = waiting & (state["blanks"] == "") & F.rlike(part, F.lit(r"^(?U)\s"))
        return F.struct(
            F.when(argument, F.concat(state["text"], F.lit("("), part, F.lit(")")))
            .when(holds, state["text"]).otherwise(F.concat(state["text"], state["blanks"], part)).alias("text"),
            F.when(holds, part).otherwise("").alias("blanks"),
            (holds | (~argument & part.isin(*FUNCTIONS))).alias("function"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("blanks"), F.lit(False).alias("function"))
    parts = F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0))
    return F.aggregate(parts, start, step, lambda state: F.concat(state["text"], state["blanks"]))


def _folded(text: Column) -> Column:
    """Every bracket group in its hidden canonical form, from the inside out.

    Each pass folds all innermost groups, so there are at most as many passes as
    opening brackets.
    """

    def strip(t: Column) -> Column:
        wrapped = t.startswith("O(") & t.endswith(")")
        bare = F.when(wrapped, F.substring(t, F.lit(3), F.length(t) - 3)).otherwise(t)
        return _applied(bare)

    def passes(t: Column) -> Column:
        opened = F.length(t) - F.length(F.translate(t, "(", ""))
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), t,
            lambda now, _: F.when(now.contains("("), _fold_innermost(now)).otherwise(now),
        )

    return _bind(_bind(F.trim(text), strip), passes)
