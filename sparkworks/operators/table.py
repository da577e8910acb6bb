"""Projection, filters, joins, sorting, set operations and record keeping (P, F, J, L, U, C, W1, A9a)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkworks.operators.ranges import settle, slice_by_position, with_position  # noqa: F401  settle is used by plans


# --- projection and metadata --------------------------------------------------


def row_sum(df: DataFrame, columns: Sequence[str], name: str = "total") -> DataFrame:
    """Sum across columns; nulls count as nothing."""
    return df.withColumn(name, reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in columns)))


def reorder_columns(df: DataFrame, column: str, position: int) -> DataFrame:
    """Move one column to a position; every column stays exactly once."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    rest = [c for c in df.columns if c != column]
    return df.select(*rest[:position], column, *rest[position:])


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def info(df: DataFrame) -> DataFrame:
    """A row per column: name, dtype and how many values are not null; one pass."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"`{c}`").alias("non_null")) for c, t in df.dtypes))
    return counts.select(F.explode(items).alias("i")).select("i.*")


def select_dtypes(df: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Columns by kind: 'number', 'string', 'boolean' or 'datetime'."""
    kinds = {"number": T.NumericType, "string": T.StringType, "boolean": T.BooleanType, "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType)}
    if (include is None) == (exclude is None):
        raise ValueError("give either include or exclude")
    kind = kinds[include or exclude]
    return df.select(*(f"`{f.name}`" for f in df.schema if isinstance(f.dataType, kind) == (include is not None)))


def split_xy(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(label), df.select(label)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"no column {old!r}")
    return df.withColumnRenamed(old, new)


def add_column_with_default(df: DataFrame, name: str, default) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def serialize(df: DataFrame, fields: Sequence[str], name: str = "json") -> DataFrame:
    """The given fields of each row as a JSON text; null fields are kept."""
    return df.withColumn(name, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def cast_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Convert a column; what cannot be converted becomes null."""
    return df.withColumn(column, F.col(column).try_cast(kind))


def set_where(df: DataFrame, condition: Column, values: dict[str, object]) -> DataFrame:
    """Set columns where the condition holds; a null condition does not."""
    return df.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


# --- filters ------------------------------------------------------------------


def any_null(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNull() for c in columns or df.columns))


def icontains(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose text has the query in it, in either case; an empty query keeps all."""
    return df if not query else df.filter(F.lower(column).contains(query.lower()))


def pk_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)


def exists(df: DataFrame, condition: Column) -> bool:
    return not df.filter(condition).isEmpty()


# --- joins --------------------------------------------------------------------


def align_on_key(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer equi-join of frames with one key column and distinct other columns."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, default=None, name: str | None = None) -> DataFrame:
    """A dimension's value by key, with a default; Spark picks the join by the dimension's size."""
    side = dim.select(F.col(dim_key).alias("_key"), F.col(value).alias("_value")).dropDuplicates(["_key"])
    found = F.col("_value") if default is None else F.coalesce("_value", F.lit(default))
    return df.join(side, df[key] == side["_key"], "left").withColumn(name or value, found).drop("_key", "_value")


def first_by_name(dim: DataFrame, name: str, symbol: str, position: str) -> DataFrame:
    """For each name the symbol that comes first."""
    return dim.groupBy(name).agg(F.min_by(symbol, position).alias(symbol))


def reverse_lookup(df: DataFrame, dim: DataFrame, name: str, symbol: str, position: str) -> DataFrame:
    return df.join(first_by_name(dim, name, symbol, position), name, "left")


def reject_existing(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows that share none of the keys with an existing row: one anti join per key."""
    return reduce(lambda a, k: a.join(existing.select(k), k, "left_anti"), keys, new)


def semi_existing(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return new.join(existing.select(key), key, "left_semi")


def hstack_by_key(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Blocks of columns side by side, matched by key."""
    return reduce(lambda a, b: a.join(b, key, "inner"), frames)


# --- order --------------------------------------------------------------------


def sort_values(df: DataFrame, columns: Sequence[str], ascending: Sequence[bool] | bool = True) -> DataFrame:
    """Mixed directions; nulls come last in both."""
    up = [ascending] * len(columns) if isinstance(ascending, bool) else ascending
    return df.orderBy(*(F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last() for c, a in zip(columns, up, strict=True)))


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last n rows in order."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n).orderBy(*order)


def slice_rows(df: DataFrame, start: int, end: int, order: Sequence[str], inclusive: bool = False) -> DataFrame:
    """Rows by position: the end is left out, or kept with ``inclusive``; only the ranges that hold such positions are shuffled."""
    last = end if inclusive else end - 1
    return slice_by_position(df, start, last, order)


def nsmallest(df: DataFrame, n: int, column: str, key: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).orderBy(column, key).limit(n)


def shuffle_rows(df: DataFrame, key: str, seed: int, name: str | None = None) -> DataFrame:
    """A permutation that depends on keys and seed alone; with ``name`` the rows have their new place in a column."""
    digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return with_position(df, [digest, key], name) if name else df.orderBy(digest, key)


def argmax(array: Column) -> Column:
    """Place of the largest element, from 0, the first of equals; null for an empty array."""
    return F.when(F.size(array) > 0, F.array_position(array, F.array_max(array)) - 1)


def argmin(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.array_position(array, F.array_min(array)) - 1)


# --- set operations -----------------------------------------------------------


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(frames: Sequence[DataFrame]) -> DataFrame:
    return concat_rows(frames).distinct()


def membership(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


# --- record keeping -----------------------------------------------------------


def insert_rows(df: DataFrame, new: DataFrame, key: str, order: Sequence[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Append rows; their ids follow the largest there is, in the given order, and missing columns get defaults."""
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    rows = with_position(new, order).crossJoin(F.broadcast(top)).withColumn(key, (F.col("_top") + F.col("position") + 1).cast(df.schema[key].dataType)).drop("_top", "position")
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return df.unionByName(rows, allowMissingColumns=True)


def update_rows(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with a change take its values, nulls included; changes without a row are ignored.

    A key that ``changes`` repeats raises an error when the result is read, for
    one row cannot take two changes; repeated null keys match no row.
    """
    names = [c for c in changes.columns if c != key]
    side = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.any_value(F.struct(*names)).alias("_new"))
    once = F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.raise_error(F.concat(F.lit("more than one change of key "), F.col(key).cast("string"))).cast(side.schema["_new"].dataType))
    out = df.join(side.select(key, once.alias("_new")), key, "left")
    return out.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns))


def delete_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti").select(*df.columns)


def delete_all(df: DataFrame) -> DataFrame:
    return df.limit(0)
