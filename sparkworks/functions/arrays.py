"""Arrays of any shape as tables (X3, X15): one row per cell, its place in columns i0, i1, ... and its value in v.

Reshaping, stacking and transposing are arithmetic on places, so none of them
shuffles; rows are put together, a block of bounded width at a time, only when
they are asked for as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CellArray:
    """Cells (i0, i1, ..., v) of an array of a shape; a cell that is missing from the table is null."""

    cells: DataFrame
    shape: tuple[int, ...]

    def places(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape))]


def _filled(spark: SparkSession, shape: Sequence[int], value: Column) -> CellArray:
    flat = CellArray(spark.range(math.prod(shape)).select(F.col("id").alias("i0"), value.alias("v")), (math.prod(shape),))
    return reshape(flat, shape)


def full(spark: SparkSession, shape: Sequence[int], value) -> CellArray:
    return _filled(spark, shape, F.lit(value))


def zeros(spark: SparkSession, shape: Sequence[int]) -> CellArray:
    return full(spark, shape, 0.0)


def ones(spark: SparkSession, shape: Sequence[int]) -> CellArray:
    return full(spark, shape, 1.0)


def eye(spark: SparkSession, n: int) -> CellArray:
    """The identity matrix with all its cells."""
    out = zeros(spark, (n, n))
    return CellArray(out.cells.withColumn("v", F.when(F.col("i0") == F.col("i1"), 1.0).otherwise(0.0)), out.shape)


def from_rows(df: DataFrame, row: str | Column, values: str | Column, shape: tuple[int, int]) -> CellArray:
    """A matrix from rows that hold an array each; ``row`` numbers them from 0."""
    place = F.col(row) if isinstance(row, str) else row
    cells = df.select(place.cast("long").alias("i0"), F.posexplode(values).alias("i1", "v"))
    return CellArray(cells.select("i0", F.col("i1").cast("long").alias("i1"), "v"), shape)


def to_rows(a: CellArray, width: int = 1 << 16) -> DataFrame:
    """(i, block, values): the rows of a matrix as arrays of at most ``width`` values, the row's blocks from 0."""
    if len(a.shape) != 2:
        raise ValueError("only a matrix has rows")
    block = F.floor(F.col("i1") / width).cast("long")
    grouped = a.cells.groupBy(F.col("i0").alias("i"), block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("i1", "v"))).alias("c"))
    return grouped.select("i", "block", F.transform("c", lambda x: x["v"]).alias("values"))


def _resolved(shape: Sequence[int], n: int) -> tuple[int, ...]:
    known = math.prod(x for x in shape if x != -1)
    if list(shape).count(-1) > 1 or any(x < -1 for x in shape) or (-1 in shape and (known == 0 or n % known)):
        raise ValueError(f"an array of {n} cells has no shape {tuple(shape)}")
    out = tuple(n // known if x == -1 else x for x in shape)
    if math.prod(out) != n:
        raise ValueError(f"an array of {n} cells has no shape {tuple(shape)}")
    return out


def _flat(a: CellArray) -> Column:
    """The place in row order."""
    return reduce(lambda at, k: at * a.shape[k] + F.col(f"i{k}"), range(1, len(a.shape)), F.col("i0")) if a.shape else F.lit(0).cast("long")


def _from_flat(shape: Sequence[int]) -> list[Column]:
    out, step = [], 1
    for k, size in reversed(list(enumerate(shape))):
        out.append(F.expr(f"_at div {step} % {max(size, 1)}").alias(f"i{k}"))
        step *= max(size, 1)
    return out[::-1]


def reshape(a: CellArray, shape: Sequence[int]) -> CellArray:
    """The same cells in row order under another shape; one length may be -1."""
    new = _resolved(shape, math.prod(a.shape))
    return CellArray(a.cells.select(_flat(a).alias("_at"), "v").select(*_from_flat(new), "v"), new)


def flatten(a: CellArray) -> CellArray:
    return reshape(a, (-1,))


def squeeze(a: CellArray) -> CellArray:
    """Without the axes of length 1."""
    return reshape(a, [x for x in a.shape if x != 1])


def transpose(a: CellArray, axes: Sequence[int] | None = None) -> CellArray:
    """Axes in another order, by default the reverse."""
    axes = list(axes) if axes is not None else list(reversed(range(len(a.shape))))
    if sorted(axes) != list(range(len(a.shape))):
        raise ValueError(f"{axes} is no order of {len(a.shape)} axes")
    return CellArray(a.cells.select(*(F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(axes)), "v"), tuple(a.shape[k] for k in axes))


def stack(arrays: Sequence[CellArray], axis: int = 0) -> CellArray:
    """One array after another along an axis; their other lengths must be equal."""
    if not arrays:
        raise ValueError("there is nothing to stack")
    shape = arrays[0].shape
    axis = axis + len(shape) if axis < 0 else axis
    if not 0 <= axis < len(shape) or any(a.shape[:axis] + a.shape[axis + 1 :] != shape[:axis] + shape[axis + 1 :] for a in arrays):
        raise ValueError(f"shapes {[a.shape for a in arrays]} do not fit along axis {axis}")
    parts, at = [], 0
    for a in arrays:
        parts.append(a.cells.select(*(((F.col(p) + at) if k == axis else F.col(p)).alias(p) for k, p in enumerate(a.places())), "v"))
        at += a.shape[axis]
    return CellArray(reduce(DataFrame.unionByName, parts), shape[:axis] + (at,) + shape[axis + 1 :])


def vstack(arrays: Sequence[CellArray]) -> CellArray:
    """Arrays below one another; a vector counts as a row."""
    return stack([reshape(a, (1, *a.shape)) if len(a.shape) == 1 else a for a in arrays], 0)


def hstack(arrays: Sequence[CellArray]) -> CellArray:
    """Arrays side by side; vectors are joined."""
    return stack(arrays, 0 if len(arrays[0].shape) == 1 else 1)


def repeat(a: CellArray, times: int, axis: int = 0) -> CellArray:
    """Every cell ``times`` times in a row along an axis."""
    place = f"i{axis}"
    cells = a.cells.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times else a.cells.limit(0).withColumn("_k", F.lit(0))
    return CellArray(cells.withColumn(place, F.col(place) * times + F.col("_k")).drop("_k"), a.shape[:axis] + (a.shape[axis] * times,) + a.shape[axis + 1 :])
