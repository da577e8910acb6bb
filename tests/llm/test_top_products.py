import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkworks.llm.top_products import best_products, top_products

SCHEMA = "vec_id long, embedding array<float>, label int, norm double, block string, uid string"


def expected(rows, k, asks):
    """By definition, in Python's integers; rows are told apart by their place."""
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(good):
        if asks(q):
            scores = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), c) for b, (c, y) in enumerate(good) if b != a and len(x) == len(y))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k=10, asks=10, **given):
    df = spark.createDataFrame([(i, v, 1, 2.0, "b", "u") for i, v in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in top_products(df, F.col("vec_id") % asks == 0, k, **given).collect())


@pytest.mark.parametrize("block,asks_block", [(8192, 1024), (40, 7)])
def test_against_brute_force(spark, block, asks_block):
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 1) * 4 ** rng.uniform(-2, 2) * (0.8**j) for j in range(12)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(2000 + i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(40)]  # another dimension
    assert run(spark, rows, block=block, asks_block=asks_block) == expected(rows, 10, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None), (10, []), (20, [0.0, 0.0]), (30, [nan, 1.0]), (40, [inf, 1.0]), (50, [None, 1.0]), (60, [1.0, 2.0]), (60, [1.0, 2.5]), (60, [1.0, 2.0]), (None, [9.0, 9.0]), (None, None), (1, [-1.0, -1.0]), (2, [0.5, 0.25]), (70, [1.0, 2.0, 3.0])]
    assert run(spark, rows) == expected(rows, 10, lambda i: i % 10 == 0)
    assert run(spark, rows, k=1, block=2, asks_block=1) == expected(rows, 1, lambda i: i % 10 == 0)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(1e9 + 64 * i)), float(np.float32(-1e9 + 128 * i)), 1.0]) for i in range(30)]
    with pytest.raises(Exception, match="64 bits"):
        run(spark, rows)
    rows = [(i, [1e5 + i, -1e5 + 3 * i, 0.5]) for i in range(30)]  # products pass 53 bits
    assert run(spark, rows) == expected(rows, 10, lambda i: i % 10 == 0)


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((4000, 32)) * 0.7 ** np.arange(32) * rng.lognormal(0, 1, (4000, 1))
    c = np.floor(1024 * base @ np.linalg.qr(rng.standard_normal((32, 32)))[0]).astype(np.int64)
    q, uid = c[::100], np.arange(4000)
    axes = np.linalg.eigh(c.T.astype(float) @ c)[1][:, ::-1]
    want = q @ c.T
    want[np.arange(len(q)), np.arange(0, 4000, 100)] = -(2**60)
    for rotation in ((axes, 6), None):
        counts = {}
        i, j, score = best_products(q, c, uid[::100], uid, uid, 10, np.full(len(q), -np.inf), rotation, piece=256, counts=counts)
        for a in range(len(q)):
            top = np.lexsort((uid, -want[a]))[:10]
            assert j[i == a].tolist() == top.tolist() and score[i == a].tolist() == want[a][top].tolist()
        assert counts["met"] < 0.8 * want.size and (rotation is None or counts["computed"] < 0.1 * want.size)
