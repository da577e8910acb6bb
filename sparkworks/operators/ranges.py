"""Rows by rank: numbering, slices, quantiles.

Ranks come from ranges with stated bounds.  A sample of the keys gives the
bounds, counting the keys by range gives each range's first rank, and both are
literals of the plan: they are as many as there are partitions, whatever the
rows.  After that a row's range is a binary search in its own task, the
same at every run, so rows need not be kept to be counted and numbered alike:
only the key columns are settled.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled keys for each range.
PER_RANGE = 64
#: Ranges that a column is cut into for its quantiles.
CUTS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and any other raises.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write to the folder that driver and executors share and read from there."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


class Order:
    """Key columns with their directions; nulls come first going up and last going down, or last in both."""

    def __init__(self, keys: Sequence[str | Column], ascending: bool | Sequence[bool] = True, nulls_last: bool = False):
        self.keys = [F.col(k) if isinstance(k, str) else k for k in keys]
        self.up = [ascending] * len(self.keys) if isinstance(ascending, bool) else list(ascending)
        if len(self.up) != len(self.keys):
            raise ValueError("there must be one direction for each key")
        self.last = [nulls_last or not up for up in self.up]

    def columns(self) -> list[Column]:
        """The keys, named k0, k1, ..."""
        return [k.alias(f"k{i}") for i, k in enumerate(self.keys)]

    def named(self) -> "Order":
        """The same order of columns k0, k1, ..."""
        out = Order([f"k{i}" for i in range(len(self.keys))], self.up)
        out.last = self.last
        return out

    def sort(self) -> list[Column]:
        return [(k.asc_nulls_last() if last else k.asc_nulls_first()) if up else (k.desc_nulls_last() if last else k.desc_nulls_first()) for k, up, last in zip(self.keys, self.up, self.last, strict=True)]

    def reached(self, bound: Column) -> Column:
        """True where the struct ``bound`` of k0, k1, ... is not after the row."""
        out = F.lit(True)
        for i, (r, up, last) in reversed(list(enumerate(zip(self.keys, self.up, self.last, strict=True)))):
            b = bound[f"k{i}"]
            empty = (b.isNotNull() & r.isNull()) if last else (b.isNull() & r.isNotNull())
            before = F.when(b.isNull() | r.isNull(), empty).otherwise(b < r if up else b > r)
            out = before | (b.eqNullSafe(r) & out)
        return out


def bucket_of(bounds: Column, most: int, reached) -> Column:
    """How many of at most ``most`` sorted bounds a row has reached: a binary search."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))))
    further = lambda at, step: (at + step <= F.size(bounds)) & reached(F.get(bounds, at + step - 1))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def _ranges(df: DataFrame, order: Order, parts: int) -> tuple[Column, list[int]]:
    """The bounds of at most ``parts`` ranges as an array of structs, and the first rank of each range, with the row count at last."""
    keys = settle(df.select(*order.columns()))
    named = order.named()
    total = keys.count()
    sample = keys.sample(min(1.0, PER_RANGE * parts / total), seed=17) if total > PER_RANGE * parts else keys
    # About PER_RANGE * parts rows, numbered in one task.
    numbered = sample.withColumn("at", F.row_number().over(Window.orderBy(*named.sort()))).withColumn("n", F.count("*").over(Window.partitionBy()))
    wide = F.greatest(F.ceil(F.col("n") / parts), F.lit(1))
    picked = numbered.filter((F.col("at") - 1) % wide == 0).filter("at > 1").orderBy("at").limit(parts).collect()
    kind = T.ArrayType(T.StructType(keys.schema.fields))
    bounds = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in keys.schema)) for r in picked)).cast(kind)
    held = {r["b"]: r["n"] for r in keys.select(bucket_of(bounds, len(picked), named.reached).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
    first = [0]
    for b in range(len(picked) + 1):
        first.append(first[-1] + held.get(b, 0))
    return bounds, first


def _placed(df: DataFrame, order: Order, ranges: tuple[Column, list[int]], parts: int, name: str, within: tuple[int, int] | None = None) -> DataFrame:
    """Rows with their rank; ``within`` leaves all ranges out that hold no rank from its first number to its last."""
    bounds, first = ranges
    rows = df.withColumn("__bucket", bucket_of(bounds, len(first) - 2, order.reached))
    if within is not None:
        wanted = [b for b in range(len(first) - 1) if first[b] <= within[1] and first[b + 1] > within[0]]
        rows = rows.filter(F.col("__bucket").between(min(wanted, default=0), max(wanted, default=-1)))
    # One range is one partition, and the lower bits of the number count its rows.
    begin = F.get(F.array(*(F.lit(x).cast("long") for x in first)), F.col("__bucket"))
    rows = rows.repartitionById(parts, F.col("__bucket")).sortWithinPartitions(*order.sort())
    return rows.withColumn(name, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + begin).drop("__bucket")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position", ascending: bool | Sequence[bool] = True, nulls_last: bool = False) -> DataFrame:
    """Position from 0 in the given order, which must tell all rows apart.

    The plan has one shuffle of the rows, by range; no task has more than a
    range of them.  How evenly they are dealt depends on how many rows share a
    whole key.  ``df`` is read twice, at first its key columns alone, and must give the same rows.
    """
    by, parts = Order(order, ascending, nulls_last), _parts(df)
    return _placed(df, by, _ranges(df, by, parts), parts, name)


def slice_by_position(df: DataFrame, first: int, last: int, order: Sequence[str | Column], name: str = "position", ascending: bool | Sequence[bool] = True, nulls_last: bool = False) -> DataFrame:
    """Rows from position ``first`` to ``last``: only ranges with such positions are shuffled, wherever they lie."""
    by, parts = Order(order, ascending, nulls_last), _parts(df)
    return _placed(df, by, _ranges(df, by, parts), parts, name, (first, last)).filter(F.col(name).between(first, last))


def with_rank_in(df: DataFrame, group: str, order: Sequence[str | Column], name: str = "rank", size: str | None = None) -> DataFrame:
    """Rank from 0 within each value of ``group`` (null is a value), and the group's row count under ``size``.

    Ranks are those of the whole table in order of group and ``order`` less the
    group's first one, so a group of most rows is spread like any other.  Only
    the groups' counts meet in one task.
    """
    counts = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy(F.col("__group").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = settle(counts.withColumn("__before", before))
    placed = with_position(df, [group, *order], "__place")
    out = placed.join(F.broadcast(counts) if counts.count() <= 100_000 else counts, placed[group].eqNullSafe(counts["__group"]))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__place") - F.col("__before")).alias(name), *([F.col("__size").alias(size)] if size else []))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """A row per column that has values: column, n (values but null) and q, the exact quantiles, interpolated.

    Approximate quantiles, whose state is bounded, cut each column into ranges.
    Values are counted by range; only the ranges that hold a wanted rank are
    looked at again, and there values are counted and the counts added up in order.  So no task holds a column.
    """
    columns = list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n long, q array<double>")
    cuts = F.array(*(F.lit((k + 1) / CUTS) for k in range(CUTS - 1)))
    wide = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    # At most CUTS numbers a column; they are approximate, so counting and choosing use these same.
    found = wide.agg(*(F.percentile_approx(c, cuts, F.lit(20 * CUTS)).alias(c) for c in wide.columns)).first()
    splits = [[-math.inf, *(sorted({x for x in found[c] or () if math.isfinite(x)}) or [0.0]), math.inf] for c in wide.columns]
    places = [f"b{i}" for i in range(len(columns))]
    placed = Bucketizer(splitsArray=splits, inputCols=wide.columns, outputCols=places, handleInvalid="keep").transform(wide)
    cells = [F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v"), F.col(f"b{i}").cast("int").alias("b")) for i in range(len(columns))]
    long = placed.select(F.inline(F.array(*cells))).filter("v is not null")
    counts = settle(long.groupBy("c", "b").agg(F.count("*").alias("n")))  # CUTS rows a column
    up_to = Window.partitionBy("c").orderBy("b")
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("c"))).withColumn("end", F.sum("n").over(up_to))
    place = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares))))
    asked = counts.select("c", "b", "n", "total", "end", place.alias("s")).select("*", ((F.col("total") - 1) * F.col("s.share")).alias("at"))
    asked = asked.select("c", "b", "total", (F.col("end") - F.col("n")).alias("begin"), "end", F.col("s.k").alias("k"), "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"))
    asked = settle(asked.filter((F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end"))).distinct())  # two rows a column and share
    held = long.join(F.broadcast(asked.select("c", "b").distinct()), ["c", "b"], "left_semi").groupBy("c", "b", "v").agg(F.count("*").alias("m"))
    held = held.withColumn("upto", F.sum("m").over(Window.partitionBy("c", "b").orderBy("v")))
    found = held.join(F.broadcast(asked), ["c", "b"]).filter((F.col("rank") - F.col("begin") < F.col("upto")) & (F.col("rank") - F.col("begin") >= F.col("upto") - F.col("m")))
    value = F.min_by("v", "rank") + F.when(F.max("rank") > F.min("rank"), (F.max_by("v", "rank") - F.min_by("v", "rank")) * (F.any_value("at") - F.min("rank"))).otherwise(0.0)
    each = found.groupBy("c", "k").agg(value.alias("x"), F.any_value("total").alias("n"))
    names = F.array(*(F.lit(c) for c in columns))
    return each.groupBy("c").agg(F.any_value("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("q")).select(F.get(names, F.col("c")).alias("column"), "n", "q")


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of each column but null, the smallest of equals; values are counted before they are shuffled."""
    one = [df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n")).agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(c)) for c in columns]
    return reduce(lambda a, b: a.crossJoin(b), one)
