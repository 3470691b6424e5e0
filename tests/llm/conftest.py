import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


# Columns whose names the operators use themselves.
CLASHING = "kept string, n_words string, rid string, hash string, id string, key string, spans string, score string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) rows, with null and clashing columns."""
    def of(rows):
        extra = [None] * len(CLASHING.split(","))
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), *extra) for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    return of


@pytest.fixture(scope="session")
def words():
    import random
    r = random.Random(5)

    def of(n, seed=None):
        g = random.Random(seed) if seed is not None else r
        return " ".join("".join(g.choice("abcdeghiostu") for _ in range(g.randint(2, 8))) for _ in range(n))
    return of


@pytest.fixture(scope="session")
def odd(words):
    """Nulls, empty, blank and very long texts, ties, repeated rows, null ids."""
    base = words(60, 1)
    return [(1, None), (2, ""), (3, " \n\t"), (4, base), (4, base), (5, base), (None, base), (None, None), (6, "one two"), (7, "one two"),
            (8, "ÜBER straße x  y"), (9, words(30_000, 2)), (10, "x" * 100_000), (11, "a " * 5_000), (12, base + " more"), (9, "another text")]
