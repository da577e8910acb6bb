"""Aggregation, profiling and descriptive statistics (A, W4)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkworks.operators.ranges import quantiles, with_position


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def group_count(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null count of every other column per key; rows with a null key are left out; ordered by key."""
    others = columns if columns is not None else [c for c in df.columns if c not in keys]
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(*(F.count(c).alias(c) for c in others)).orderBy(*keys)


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Frequency of each value but null, most frequent first; shares are of all rows, null or not."""
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    if normalize:
        total = df.agg(F.count("*").alias("_total"))
        counts = counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("count") / F.col("_total")).drop("_total")
    return counts.filter(F.col(column).isNotNull()).orderBy(F.desc("count"), column)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per column.

    Numeric: count, mean, sample std, min, interpolated quartiles, max.  Text:
    count, unique, top (smallest of the most frequent) and freq.
    """
    columns = list(columns or df.columns)
    numeric = set(numeric_columns(df))
    items, aggregates = [], []
    for c in columns:
        q = f"`{c}`"
        if c in numeric:
            aggregates += [F.count(q).alias(f"{c}:n"), F.avg(q).alias(f"{c}:mean"), F.stddev_samp(q).alias(f"{c}:std"), F.min(q).cast("double").alias(f"{c}:min"), F.max(q).cast("double").alias(f"{c}:max")]
    wide = df.agg(*aggregates) if aggregates else None
    quarters = quantiles(df, [c for c in columns if c in numeric], (0.25, 0.5, 0.75)) if aggregates else None
    for c in columns:
        if c in numeric:
            at = lambda k, c=c: F.col(f"`{c}:{k}`")
            items.append(F.struct(F.lit(c).alias("column"), at("n").alias("count"), at("mean").alias("mean"), at("std").alias("std"), at("min").alias("min"), at("max").alias("max")))
    parts = []
    if items:
        # A row per column on either side.
        q = [F.get("q", F.lit(k)).alias(name) for k, name in enumerate(("p25", "p50", "p75"))]
        parts = [wide.select(F.explode(F.array(*items)).alias("i")).select("i.*").join(F.broadcast(quarters.select("column", *q)), "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")]
    text = [c for c in columns if c not in numeric]
    if text:
        # One scan for all text columns: each value beside its column's place.
        cells = F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(text)))
        freq = df.select(F.inline(cells)).filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
        found = freq.groupBy("c").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"), F.max("n").alias("freq"))
        names = df.sparkSession.createDataFrame(list(enumerate(text)), "c int, column string")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        parts.append(names.join(found, "c", "left").select("column", zero("count"), zero("unique"), "top", "freq"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def basic_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, population std and variance, min, max and sum in one row."""
    c = F.col(column)
    one = df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("var"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"))
    middle = quantiles(df, [column], (0.5,)).agg(F.max(F.get("q", F.lit(0))).alias("median"))
    return one.crossJoin(F.broadcast(middle)).select("mean", "median", "std", "var", "min", "max", "sum")


def row_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least and greatest across columns, passing over nulls."""
    values = [F.col(c) for c in columns]
    return df.withColumn("row_min", F.least(*values)).withColumn("row_max", F.greatest(*values))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: nulls, other values and rows, in one pass; the first two add up to the third."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count("*").alias("_rows"), *(F.count(F.col(f"`{c}`")).alias(c) for c in columns))
    items = F.array(*(F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col(f"`{c}`")).alias("nulls"), F.col(f"`{c}`").alias("non_nulls"), F.col("_rows").alias("rows")) for c in columns))
    return wide.select(F.explode(items).alias("i")).select("i.*")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of equals."""
    return frequencies(df, column).agg(F.min_by(column, F.struct(-F.col("n"), column)).alias("mode"))


def least_common(df: DataFrame, column: str) -> DataFrame:
    """The least frequent value, the smallest of equals."""
    return frequencies(df, column).agg(F.min_by(column, F.struct("n", column)).alias("least_common"))


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*(F.avg(c).alias(c) for c in columns))


def chunked_group_count(df: DataFrame, keys: Sequence[str], chunk: int, order: Sequence[str], merge: bool = False) -> DataFrame:
    """Counts per chunk of ``chunk`` consecutive rows and key, or over all chunks with ``merge``."""
    if merge:
        return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    placed = with_position(df.select(*dict.fromkeys([*keys, *order])), order)
    return placed.na.drop(subset=list(keys)).groupBy(F.floor(F.col("position") / chunk).alias("chunk"), *keys).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(column) if approximate else F.count_distinct(column)).alias("n"))


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix in long form (a, b, r), each pair over the rows where both are present; one pass."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    wide = df.agg(*(F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias(f"{i}") for i, (a, b) in enumerate(pairs)), *(F.corr(c, c).alias(f"d{i}") for i, c in enumerate(columns)))
    cell = lambda a, b, name: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{name}`").alias("r"))
    cells = [cell(c, c, f"d{i}") for i, c in enumerate(columns)] + [cell(x, y, f"{i}") for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def lower_triangle(corr: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs below the diagonal of the matrix in the order of ``columns``."""
    place = F.create_map(*(F.lit(x) for i, c in enumerate(columns) for x in (c, i)))
    return corr.filter(place[F.col("a")] > place[F.col("b")])


def feature_impact(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of each numeric feature with the label, largest first."""
    if label not in df.columns:
        raise ValueError(f"no column {label!r}")
    if label not in numeric_columns(df):
        raise TypeError(f"the label {label!r} is not numeric")
    features = [c for c in columns or numeric_columns(df) if c != label]
    both = lambda c: F.col(c).isNotNull() & F.col(label).isNotNull()
    wide = df.agg(*(F.corr(F.when(both(c), F.col(c)), F.when(both(c), F.col(label))).alias(c) for c in features))
    items = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("impact")) for c in features))
    return wide.select(F.explode(items).alias("i")).select("i.*").orderBy(F.col("impact").desc_nulls_last(), "feature")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the least and the greatest value, the last one closed: bin (from 0), low, high, n.

    Empty bins are listed; where all values are equal the range is widened by a half to either side.
    """
    x = F.col(column).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    counts = df.filter(x.isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(F.least(F.width_bucket(x, F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins)).alias("b")).agg(F.count("*").alias("n"))
    edges = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("b"))
    width = (F.col("hi") - F.col("lo")) / bins
    out = edges.join(F.broadcast(counts), "b", "left")
    return out.select((F.col("b") - 1).cast("int").alias("bin"), (F.col("lo") + (F.col("b") - 1) * width).alias("low"), (F.col("lo") + F.col("b") * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def kde(df: DataFrame, column: str, grid: Sequence[float], bandwidth: float, by: str | None = None) -> DataFrame:
    """Gaussian kernel density at the points of a grid, per class.

    Every row is spread over the grid, whose size is the caller's, and summed at once.
    """
    scale = 1 / (bandwidth * math.sqrt(2 * math.pi))
    at = F.explode(F.array(*(F.lit(float(g)) for g in grid)))
    keys = [by] if by else []
    kernel = F.exp(-F.pow((F.col("at") - F.col(column)) / bandwidth, 2) / 2) * scale
    return df.filter(F.col(column).isNotNull()).select(*keys, column, at.alias("at")).groupBy(*keys, "at").agg(F.avg(kernel).alias("density"))


def scatter_sample(df: DataFrame, key: str, columns: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """A sample of points by a hash of the key, the same at every run."""
    return df.filter(hash_share(key, seed) < share).select(key, *columns)


def hash_share(key: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def proportion_compare(overall: DataFrame, first: DataFrame, second: DataFrame, column: str, names: tuple[str, str] = ("stratified", "random")) -> DataFrame:
    """Class shares of a table and of two parts of it, and the parts' errors in percent."""
    share = lambda df, name: value_counts(df, column, normalize=True).select(column, F.col("share").alias(name))
    out = share(overall, "overall").join(share(first, names[0]), column, "full").join(share(second, names[1]), column, "full")
    return out.withColumns({f"{n}_error": 100 * F.col(n) / F.col("overall") - 100 for n in names}).orderBy(column)


def vocab_and_max_len(df: DataFrame, label: str) -> DataFrame:
    """The distinct characters in order, joined, and the length of the longest label."""
    chars = df.select(F.explode(F.array_distinct(F.split(F.col(label), ""))).alias("c")).filter("c <> ''").distinct().agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("vocab"))
    return chars.crossJoin(F.broadcast(df.agg(F.max(F.length(label)).alias("max_len"))))


def andrews_curves(df: DataFrame, key: str, columns: Sequence[str], n: int = 5) -> DataFrame:
    """x1 / sqrt 2 + x2 sin t + x3 cos t + x4 sin 2t + ... at n points t of [-pi, pi] for every row."""
    step = 2 * math.pi / (n - 1)
    t = F.col("t")
    terms = [F.col(columns[0]) / F.lit(math.sqrt(2))]
    for k, c in enumerate(columns[1:], 1):
        wave = F.sin if k % 2 else F.cos
        terms.append(F.col(c) * wave(t * ((k + 1) // 2)))
    points = F.explode(F.array(*(F.lit(-math.pi + k * step) for k in range(n))))
    return df.select(key, *columns, points.alias("t")).select(key, "t", reduce(lambda a, b: a + b, terms).alias("f"))


def parallel_coordinates(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide to long: one row per id and column."""
    return df.unpivot(list(ids), list(columns), "variable", "value")


def zscore(df: DataFrame, column: str, name: str = "z") -> DataFrame:
    """(x - mean) / population std; a column without spread gives 0."""
    stats = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"))
    z = (F.col(column) - F.col("_mean")) / F.when(F.col("_std") != 0, F.col("_std"))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, F.when(F.col("_std") == 0, F.col(column) * 0.0).otherwise(z)).drop("_mean", "_std")
