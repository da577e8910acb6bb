"""Arrays as cell tables, against numpy."""

import numpy as np
import pytest

from sparkworks.functions import arrays as A


def cells(spark, x):
    names = ", ".join(f"i{k} long" for k in range(x.ndim))
    return A.CellArray(spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(x)], f"{names}, v double").repartition(3), x.shape)


def back(a):
    out = np.full(a.shape, np.nan)
    for r in a.cells.collect():
        out[tuple(r[: len(a.shape)])] = r["v"]
    return out


def test_reshape_transpose_stack(spark):
    x = np.arange(24.0).reshape(2, 3, 4)
    a = cells(spark, x)
    for shape in ((24,), (4, 6), (3, 2, 4), (-1, 2), (1, 24, 1), (2, 2, 2, 3)):
        assert np.array_equal(back(A.reshape(a, shape)), x.reshape(shape))
    for axes in (None, (1, 0, 2), (2, 0, 1)):
        assert np.array_equal(back(A.transpose(a, axes)), x.transpose(axes))
    assert np.array_equal(back(A.flatten(a)), x.ravel())
    assert np.array_equal(back(A.squeeze(A.reshape(a, (1, 24, 1)))), x.ravel())
    for axis in (0, 1, 2, -1):
        assert np.array_equal(back(A.stack([a, a, a], axis)), np.concatenate([x, x, x], axis))
    v, w = cells(spark, np.array([1.0, 2, 3, 4])), cells(spark, np.array([5.0, 6, 7, 8]))
    assert np.array_equal(back(A.vstack([v, w, v])), np.vstack([back(v), back(w), back(v)]))
    assert np.array_equal(back(A.hstack([v, w])), np.hstack([back(v), back(w)]))
    assert np.array_equal(back(A.hstack([A.ones(spark, (2, 4)), A.zeros(spark, (2, 2))])), np.hstack([np.ones((2, 4)), np.zeros((2, 2))]))


def test_no_shuffle(spark):
    a = A.ones(spark, (40, 6))
    plan = A.transpose(A.stack([A.reshape(a, (60, 4)), A.zeros(spark, (2, 4))]))
    assert "Exchange" not in plan.cells._jdf.queryExecution().executedPlan().toString()


def test_filled_arrays(spark):
    assert np.array_equal(back(A.full(spark, (3, 2), 2.0)), np.full((3, 2), 2.0))
    assert np.array_equal(back(A.eye(spark, 4)), np.eye(4))
    assert np.array_equal(back(A.repeat(A.eye(spark, 3), 2, 1)), np.repeat(np.eye(3), 2, 1))
    assert A.repeat(A.eye(spark, 3), 0).cells.count() == 0 and A.zeros(spark, (0, 3)).cells.count() == 0


def test_rows_in_blocks(spark):
    x = np.arange(21.0).reshape(3, 7)
    got = {(r["i"], r["block"]): r["values"] for r in A.to_rows(cells(spark, x), width=3).collect()}
    assert got == {(i, b): x[i, 3 * b : 3 * b + 3].tolist() for i in range(3) for b in range(3)}
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, None])], "r int, v array<double>")
    again = A.from_rows(df, "r", "v", (2, 2))
    assert sorted((r["i0"], r["i1"], r["v"]) for r in again.cells.filter("v is not null").collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)]


def test_wrong_shapes(spark):
    a = A.ones(spark, (2, 3))
    for f in (lambda: A.reshape(a, (4, 2)), lambda: A.reshape(a, (-1, -1)), lambda: A.reshape(a, (-1, 4)), lambda: A.transpose(a, (0, 0)), lambda: A.stack([a, A.ones(spark, (2, 2))]), lambda: A.stack([]), lambda: A.stack([a], 2), lambda: A.to_rows(A.ones(spark, (3,)))):
        with pytest.raises(ValueError):
            f()
