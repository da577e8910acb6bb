"""Exact and indexed search for near vectors."""

import os
import random

import numpy as np
import pytest

from sparkworks.operators import neighbours


def brute(queries, points, k):
    out = []
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(p, float) - np.array(v, float)) ** 2).sum())), i) for i, p in points if p and v and len(p) == len(v) and None not in p and None not in v)
        out += [(q, i, d, r) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out, key=lambda x: (x[0], x[3]))


def same(got, want):
    got = sorted((tuple(r) for r in got), key=lambda x: (x[0], x[3]))
    assert [(q, p, r) for q, p, _, r in got] == [(q, p, r) for q, p, _, r in want]
    assert [d for _, _, d, _ in got] == pytest.approx([d for _, _, d, _ in want], abs=1e-12)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    out = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(900)]
    out += [(1000 + i, out[7][1]) for i in range(40)]  # ties
    return out + [(2000 + i, [rng.random() for _ in range(3)]) for i in range(30)] + [(3000, None), (3001, []), (3002, [None, 1.0, 2.0])]


@pytest.mark.parametrize("limit", [1 << 26, 4000])
def test_exact_search(spark, vectors, limit):
    points = spark.createDataFrame(vectors, "id long, v array<double>").repartition(5)
    queries = points.filter("id % 9 = 0 or id > 2025")
    asked = [x for x in vectors if x[0] % 9 == 0 or x[0] > 2025]
    same(neighbours.knn_join(queries, points, 5, "id", "id", "v", limit=limit).collect(), brute(asked, vectors, 5))


def test_text_keys_and_few_points(spark):
    points = spark.createDataFrame([("b", [1.0]), ("é", [1.0]), ("a", [1.0]), ("z", [0.5])], "id string, v array<float>")
    for limit in (1 << 26, 1):
        got = neighbours.knn_join(points, points, 3, "id", "id", "v", limit=limit).filter("query_id = 'z'").orderBy("rank").collect()
        assert [r["id"] for r in got] == ["z", "a", "b"]
        assert neighbours.knn_join(points, points.limit(0), 3, "id", "id", "v", limit=limit).count() == 0
        assert neighbours.knn_join(points.limit(0), points, 3, "id", "id", "v", limit=limit).count() == 0


def test_points_are_not_crossed(spark, vectors):
    points = spark.createDataFrame(vectors, "id long, v array<double>")
    plan = neighbours.knn_join(points.filter("id < 9"), points, 3, "id", "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall_of_the_index(spark, tmp_path):
    points = spark.read.parquet(f"{DATA}/embeddings.parquet")
    queries = points.filter("vec_id % 20 = 0")
    exact = {(r["query_vec_id"], r["vec_id"]) for r in neighbours.knn_join(queries, points, 4, "vec_id", "vec_id", "embedding").collect()}
    neighbours.build_index(points, "vec_id", "embedding", path=str(tmp_path / "index"))
    index = neighbours.VectorIndex.load(spark, str(tmp_path / "index"))
    assert index.cells.count() == points.count()
    found = index.search(queries, 4, "vec_id", "embedding", "vec_id")
    got = {(r["query_vec_id"], r["vec_id"]) for r in found.collect()}
    recall = len(got & exact) / len(exact)
    print("recall at 4:", recall, "cells:", len(index.centres), "probes:", index.probes)
    assert recall >= 0.9 and index.probes < len(index.centres)
    every = index.search(queries, 4, "vec_id", "embedding", "vec_id", probes=len(index.centres), block=100)
    assert {(r["query_vec_id"], r["vec_id"]) for r in every.collect()} == exact


def test_few_cells_do_for_clusters():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((40, 16)) * 10)[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))
    assert neighbours.probes_for(x, neighbours.fit_centres(x, 63), 0.95) <= 4


def test_index_of_odd_tables(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0])] + [(10 + i, [5.0, 5.0]) for i in range(200)]  # most rows in one cell
    points = spark.createDataFrame(rows, "id long, v array<double>")
    index = neighbours.build_index(points, "id", "v", cells=3)
    got = index.search(points.filter("id in (1, 11)"), 3, "id", "v", "id", probes=3, block=16)
    assert sorted((r["query_id"], r["id"]) for r in got.collect()) == [(1, 1), (1, 2), (1, 10), (11, 10), (11, 11), (11, 12)]
    empty = neighbours.build_index(points.limit(0), "id", "v")
    assert empty.search(points, 3, "id", "v", "id").count() == 0
