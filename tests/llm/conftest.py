import random

import pytest

from corpus_rows import table_of, words


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    rows = [(k, words(rng, rng.randrange(1, 60)), rng.choice(["aa", "bb", None]), rng.choice(["s1", "s2", None])) for k in range(60)]
    rows += [(100, None, "aa", "s1"), (101, "", None, None), (102, " \t\n ", "bb", "s2"), (None, "w1 w2 w3", None, None), (None, None, None, None)]
    rows += [(110, words(rng, 30_000), "aa", "s1"), (111, "x" * 200_000, "bb", "s2")]
    rows += [rows[3]] * 3 + [(120, rows[4][1], "aa", "s1"), (121, "  " + rows[4][1], "aa", "s1"), (122, rows[4][1].replace(" ", "\n"), "aa", "s1")]
    rows += [(130, "É\U0001F600 ünï co de", "bb", "s2"), (131, "A B C", "aa", "s1"), (132, "a b c", "aa", "s1")]
    return table_of(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return table_of(spark, [])
