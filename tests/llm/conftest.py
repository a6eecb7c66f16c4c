import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from rankwell.session import local_session  # noqa: E402

#: Columns whose names operators might use themselves.
CLASHING = "n bigint, key bigint, rep bigint, kept boolean, recipe string, block int, lang string"
DOCS = f"doc_id bigint, text string, {CLASHING}"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, app="rankwell-tests")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from (id, text) pairs, with columns whose names clash."""

    def make(pairs):
        rows = [(i, t, 7, 8, 9, True, "r", 1, "en") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


def words(rnd, n, vocabulary=40):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empty and blank texts, repeats, ties, near copies and one long text."""
    rnd = random.Random(5)
    base = words(rnd, 60)
    near = base[:30] + ["changed"] + base[31:]
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (4, " ".join(base)), (5, " ".join(base))]
    rows += [(6, "  ".join(base)), (7, " ".join(near)), (8, "one two three"), (8, "one two three")]
    rows += [(9, "One TWO three"), (10, " ".join(words(rnd, 20_000, 3000))), (11, "x" * 5000), (12, "é ß 日本 !?")]
    rows += [(i, " ".join(words(rnd, rnd.randrange(1, 80), 12))) for i in range(20, 60)]
    return rows
