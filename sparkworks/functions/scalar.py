"""Column expressions (X)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_divide(a: Column, b: Column) -> Column:
    """Quotient rounded down; null for a zero divisor."""
    return F.floor(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    return F.when(b != 0, a - b * F.floor(a / F.when(b != 0, b)))


def half_even(a: Column, digits: int = 0) -> Column:
    return F.bround(a, digits)


def full(value, n: int) -> Column:
    return F.array_repeat(F.lit(value), n)


def identity(n: int) -> Column:
    """n rows of an identity matrix."""
    row = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(row, lambda i: F.transform(row, lambda j: F.when(i == j, 1).otherwise(0)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def matmul(a, b):
    """Product of matrices in (i, j, v) rows: a join on the inner index and a sum."""
    right = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    return a.join(right, "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("k", "j")


def item(a: Column, k: int) -> Column:
    """Element from 0, or from the end where k is negative; null outside."""
    return F.get(a, F.lit(k)) if k >= 0 else F.get(a, F.size(a) + k)


def array_slice(a: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """start:stop:step with the usual meaning of negative places."""
    n = F.size(a)
    at = lambda k, default: default if k is None else (F.lit(k) if k >= 0 else n + k)
    low, high = at(start, F.lit(0)), at(stop, n)
    return F.filter(a, lambda x, i: (i >= low) & (i < high) & (F.pmod(i - low, F.lit(step)) == 0))


def replace_item(a: Column, k: int, value) -> Column:
    return F.transform(a, lambda x, i: F.when(i == k, F.lit(value)).otherwise(x))


def count_of(a: Column, value) -> Column:
    return F.size(F.filter(a, lambda x: x == F.lit(value)))


def index_of(a: Column, value) -> Column:
    """Place of the first equal element, from 0; -1 where there is none."""
    return (F.array_position(a, value) - 1).cast("int")


def map_get(m: Column, key, default=None) -> Column:
    found = F.try_element_at(m, F.lit(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def nth_key(m: Column, n: Column) -> Column:
    """The n-th key, from 1; null outside."""
    return F.get(F.map_keys(m), n - 1)


def capitalize(s: Column) -> Column:
    """First character upper case, the others lower case."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def parse_day(s: Column, fmt: str = "dd-MM-yyyy") -> Column:
    """A date from text, null where it is none."""
    return F.try_to_date(s, fmt)
