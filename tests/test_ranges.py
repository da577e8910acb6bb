"""Numbering, slices, ranks within groups and quantiles, against Python's."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkworks.operators import models, prep, ranges, stats, table

SCHEMA = "k long, g string, x double, y double, d date, other string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    out = []
    for k in range(3000):
        x = None if k % 17 == 0 else float("nan") if k % 101 == 0 else 5.0 if k % 3 == 0 else rng.gauss(0, 1)  # a third has one value
        out.append((k, None if k % 13 == 0 else "hot" if k % 3 else rng.choice("abc"), x, float(k % 7), None, "o"))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def sort_value(v, up, last):
    """A key that sorts as Spark does: nulls at the asked end, NaN above all numbers."""
    if v is None:
        return (1 if last else -1, 0)
    if isinstance(v, float) and math.isnan(v):
        v = math.inf
    return (0, v if up else -v)


def test_positions_in_every_direction(df, rows):
    for up, last in (([True, True], False), ([False, True], False), ([True, False], True), ([False, False], True)):
        got = {r["k"]: r["at"] for r in table.with_position(df, ["x", "k"], "at", up, last).collect()}
        want = sorted(rows, key=lambda r, up=up, last=last: (sort_value(r[2], up[0], last or not up[0]), sort_value(r[0], up[1], last or not up[1])))
        assert got == {r[0]: i for i, r in enumerate(want)}


def test_one_shuffle_of_rows_and_keys_alone_settled(df):
    plan = table.with_position(df, ["x", "k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 2  # one is that of df itself
    assert "Window" not in plan and "Join" not in plan


def test_ranges_are_even_and_all_rows_numbered(spark):
    big = spark.range(200_000).select(F.xxhash64("id").alias("h"), F.lit("wide" * 10).alias("w"))
    parts = [r["n"] for r in ranges.with_position(big, ["h"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 4 and max(parts) < 1.5 * 200_000 / 4
    assert ranges.with_position(big, ["h"]).agg(F.min("position"), F.max("position"), F.count_distinct("position")).first() == (0, 199_999, 200_000)


def test_slices_read_only_their_ranges(spark, df, rows):
    order = sorted(r[0] for r in rows)
    for a, b in ((0, 3), (1490, 1510), (2995, 4000), (10, 10), (5000, 6000)):
        assert sorted(r["k"] for r in table.slice_rows(df, a, b, ["k"]).collect()) == order[a:b]
    big = spark.range(100_000).withColumn("h", F.md5(F.col("id").cast("string")))
    placed = table.slice_rows(big, 60_000, 60_010, ["h"])
    assert placed.count() == 10
    # What comes out of the shuffle is the ranges with those positions, not the table.
    wide = ranges._placed(big, ranges.Order(["h"]), ranges._ranges(big, ranges.Order(["h"]), 4), 4, "p", (60_000, 60_009))
    assert wide.count() < 50_000


def test_rank_in_group(df, rows):
    got = {r["k"]: (r["at"], r["n"]) for r in ranges.with_rank_in(df, "g", ["k"], "at", size="n").collect()}
    for g in {r[1] for r in rows}:
        own = sorted(r[0] for r in rows if r[1] == g)
        assert [got[k] for k in own] == [(i, len(own)) for i in range(len(own))]


def test_folds_of_a_class_differ_by_one_at_most(df):
    placed = models.with_folds(df, "k", "g", 7)
    sizes = placed.groupBy("g", "fold").agg(F.count("*").alias("n")).groupBy("g").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("m")).collect()
    assert len(sizes) == 5 and all(r["b"] - r["a"] <= 1 and r["m"] == 7 for r in sizes)
    assert {r["k"]: r["fold"] for r in placed.collect()} == {r["k"]: r["fold"] for r in models.with_folds(df.repartition(3), "k", "g", 7).collect()}
    assert placed.columns == [*df.columns, "fold"]


def test_quantiles_against_sorted_values(spark, df, rows):
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    numbers = df.filter("x is null or not isnan(x)")
    got = {r["column"]: r for r in ranges.quantiles(numbers, ["x", "y"], shares).collect()}
    for c, at in (("x", 2), ("y", 3)):
        values = sorted(r[at] for r in rows if r[at] is not None and not (r[2] is not None and math.isnan(r[2])))
        assert got[c]["n"] == len(values)
        for share, q in zip(shares, got[c]["q"], strict=True):
            place = (len(values) - 1) * share
            low, high = values[math.floor(place)], values[math.ceil(place)]
            assert q == pytest.approx(low + (high - low) * (place - math.floor(place)), abs=1e-12)


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(None, 1, 7.0), (None, 1, None)], "a double, b int, c double")
    assert {r["column"]: (r["n"], r["q"]) for r in ranges.quantiles(df, ["a", "b", "c"], (0.5, 1.0)).collect()} == {"b": (2, [1.0, 1.0]), "c": (1, [7.0, 7.0])}
    assert ranges.quantiles(df.limit(0), ["a", "b"], (0.5,)).count() == 0
    described = {r["column"]: r for r in stats.describe(df, ["a", "b"]).collect()}
    assert described["a"]["count"] == 0 and described["a"]["p50"] is None and described["b"]["p25"] == 1.0
    assert stats.basic_stats(df, "a").first()["median"] is None
    assert prep.impute_fit(df, ["a", "b", "c"]) == {"b": 1.0, "c": 7.0}
    assert prep.fill_missing(df, "mode", ["c"]).select("c").collect() == [(7.0,), (7.0,)]


def test_no_task_holds_a_column(spark):
    """Ranks are found in the two ranges that hold them."""
    big = spark.range(300_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    want = big.agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).first()["q"]
    assert ranges.quantiles(big, ["v"], (0.1, 0.5)).first()["q"] == pytest.approx(want)


def test_clashing_names(spark):
    df = spark.createDataFrame([(3, "a", 1, 2, 3), (1, "b", 1, 2, 3), (2, "a", 1, 2, 3)], "k0 int, _group string, _bounds int, _first int, n int")
    placed = table.with_position(df, ["k0"], "at")
    assert placed.columns == [*df.columns, "at"] and {r["k0"]: r["at"] for r in placed.collect()} == {1: 0, 2: 1, 3: 2}
    ranked = ranges.with_rank_in(df, "_group", ["k0"], "_size", size="all")
    assert {r["k0"]: (r["_size"], r["all"]) for r in ranked.collect()} == {1: (0, 1), 2: (0, 2), 3: (1, 2)}
    assert {r["column"] for r in ranges.quantiles(df, ["k0", "n"], (0.5,)).collect()} == {"k0", "n"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert table.with_position(none, ["k"]).count() == 0
    assert table.slice_rows(none, 0, 5, ["k"]).count() == 0
    assert models.with_folds(none, "k", "g", 3).count() == 0


def test_shared_folder_is_asked_for_off_a_local_master(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ranges.shared_folder(Session())
