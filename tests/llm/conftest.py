import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, score double, digest string, n_words long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, ties, near copies and shared passages."""
    rng = random.Random(3)
    passage = words(rng, 70)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base.upper()), (3, " ".join(near)), (4, words(rng, 30) + "\n" + passage + "\t" + words(rng, 40)), (5, words(rng, 45) + " " + passage), (6, passage),
        (7, None), (8, ""), (9, "  \n "), (10, "one two"), (11, "One Two"), (12, words(rng, 12_000)), (13, "x" * 4_000), (14, "é ü ß 中文 😀   tail"),
        (1, base), (None, base), (None, None), (15, "12 34 ###"), (16, "á ño"), (5, "another text under an id that is taken"),
    ]
    return [(i, t, None if k % 5 == 0 else "en" if k % 2 else "de", None if k % 3 else "s", None, "x", 1, None, "d", 7) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
