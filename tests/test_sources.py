"""Sources, sinks and generators: files, options of connectors, seeded columns."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkworks.functions import scalar
from sparkworks.operators import prep, stats, table
from sparkworks.sources import io


class Recorder:
    """Stands for a reader or writer and keeps what it is told."""

    def __init__(self):
        self.kind, self.given = None, {}

    def format(self, kind):
        self.kind = kind
        return self

    def option(self, key, value):
        self.given[key] = value
        return self

    def options(self, **given):
        self.given.update(given)
        return self

    def load(self):
        return self


class Session:
    def __init__(self):
        self.read = self.readStream = Recorder()


def test_text_lines_written_appended_and_read(spark, tmp_path):
    path = str(tmp_path / "lines")
    io.write_text_lines(spark.createDataFrame([("one",), ("é two",), ("",)], "value string"), path)
    io.write_text_lines(spark.createDataFrame([("three",)], "value string"), path, append=True)
    assert sorted(r["value"] for r in io.read_text_lines(spark, path).collect()) == ["", "one", "three", "é two"]
    io.write_text_lines(spark.createDataFrame([("new",)], "value string"), path)
    assert io.read_text_lines(spark, path).count() == 1


def test_jdbc_options():
    plain = io.read_jdbc(Session(), "jdbc:x://h/db", "t")
    assert plain.kind == "jdbc" and plain.given == {"url": "jdbc:x://h/db", "dbtable": "t"}
    full = io.read_jdbc(Session(), "jdbc:x://h/db", "t", "org.X", ("id", 0, 900, 9))
    assert full.given == {"url": "jdbc:x://h/db", "dbtable": "t", "driver": "org.X", "partitionColumn": "id", "lowerBound": 0, "upperBound": 900, "numPartitions": 9}


def test_message_queue_options(spark, monkeypatch):
    assert io.kafka_options("a:1,b:2", "words", True) == {"kafka.bootstrap.servers": "a:1,b:2", "topic": "words"}
    assert io.kafka_options("a:1", "words", False) == {"kafka.bootstrap.servers": "a:1", "subscribe": "words"}
    told = []

    class Writer(Recorder):
        def __init__(self, df):
            super().__init__()
            told.append((df.columns, self))

    monkeypatch.setattr(type(spark.range(1)), "write", property(Writer))
    sink = io.kafka_json_sink(spark.createDataFrame([("hi",)], "text string"), "words", "a:1")
    assert sink.kind == "kafka" and sink.given["topic"] == "words" and told[0][0] == ["value"]
    session = Session()
    session.readStream.load = lambda: spark.createDataFrame([('{"message": "m"}', b"k"), ("{", b"k")], "value string, key binary")
    got = io.kafka_json_source(session, "words", "a:1")
    assert session.readStream.kind == "kafka" and session.readStream.given == {"kafka.bootstrap.servers": "a:1", "subscribe": "words", "startingOffsets": "earliest"}
    assert [r["message"] for r in got.collect()] == ["m", None]


def test_frames_from_rows_and_columns(spark):
    want = [(1, "a"), (2, None)]
    assert [tuple(r) for r in io.from_rows(spark, [{"x": 1, "y": "a"}, {"x": 2}], "x int, y string").collect()] == want
    assert [tuple(r) for r in io.from_rows(spark, {"x": [1, 2], "y": ["a", None]}, T.StructType.fromDDL("x int, y string")).collect()] == want
    with pytest.raises(ValueError):
        io.from_rows(spark, {"x": [1, 2], "y": ["a"]}, "x int, y string")


def test_seeded_columns_do_not_depend_on_partitions(spark):
    kinds = {"u": ("uniform",), "z": ("normal",), "d": ("integer", -2, 3)}
    frames = [io.random_columns(spark.range(3000).repartition(n), "id", kinds, 9) for n in (1, 8, 211)]
    rows = [sorted(tuple(r) for r in f.collect()) for f in frames]
    assert rows[0] == rows[1] == rows[2] == sorted(tuple(r) for r in io.random_table(spark, 3000, kinds, 9).collect())
    assert rows[0] != sorted(tuple(r) for r in io.random_table(spark, 3000, kinds, 10).collect())
    u, z, d = (np.array([r[k] for r in rows[0]], float) for k in (1, 2, 3))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(u.var() - 1 / 12) < 0.005
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.04 and np.abs(z).max() < 6 and abs(np.corrcoef(u, z)[0, 1]) < 0.06
    assert set(d) == {-2, -1, 0, 1, 2} and min(np.bincount((d + 2).astype(int))) > 500
    with pytest.raises(ValueError):
        io.random_columns(spark.range(1), "id", {"x": ("other",)})


def test_circles(spark):
    got = io.make_circles(spark, 101, factor=0.5).collect()
    assert [r["label"] for r in sorted(got, key=lambda r: r["id"])] == [0] * 50 + [1] * 51
    assert all(math.hypot(r["X1"], r["X2"]) == pytest.approx(0.5 if r["label"] else 1.0) for r in got)
    noisy = [sorted(tuple(r) for r in io.make_circles(spark, 60, noise=0.1, seed=2).repartition(n).collect()) for n in (1, 7)]
    assert noisy[0] == noisy[1]


def test_columns_by_kind(spark):
    df = spark.createDataFrame([(1, 1.5, "x", True, datetime.date(2020, 1, 1), None)], "i int, d double, s string, b boolean, day date, t timestamp")
    assert table.select_dtypes(df, include="number").columns == ["i", "d"]
    assert table.select_dtypes(df, include="datetime").columns == ["day", "t"]
    assert table.select_dtypes(df, exclude="string").columns == ["i", "d", "b", "day", "t"]
    with pytest.raises(ValueError):
        table.select_dtypes(df)
    x, y = table.split_xy(df, "s")
    assert x.columns == ["i", "d", "b", "day", "t"] and y.columns == ["s"]
    assert table.shape(df) == (1, 6)


def test_columns_without_nulls_stay(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 3, "b")], "x int, y int, `z.z` string")
    assert prep.drop_columns_with_nulls(df).columns == ["x", "z.z"]
    assert prep.drop_columns_with_nulls(df.limit(0)).columns == ["x", "y", "z.z"]


def test_null_safe_comparison_and_counts(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None), (2, 1)], "a int, b int")
    assert [r[0] for r in df.select(F.col("a").eqNullSafe(F.col("b"))).collect()] == [True, False, True, False]
    assert stats.distinct_count(df, "a").first()[0] == 2 and stats.distinct_count(df, "a", approximate=True).first()[0] == 2
    assert table.exists(df, F.col("a") == 2) and not table.exists(df, F.col("a").isNull() & F.col("b").isNotNull())


def test_arrays_and_maps_at_their_edges(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 0, 4], {"a": 1, "b": 2})], "x array<int>, y array<int>, m map<string, int>")
    one = lambda c: df.select(c.alias("v")).first()["v"]
    x, y, m = F.col("x"), F.col("y"), F.col("m")
    assert one(scalar.divide(x, y)) == [0.5, None, 0.75] and one(scalar.multiply(x, y)) == [2, 0, 12]
    assert one(scalar.add(x, y)) == [3, 2, 7] and one(scalar.subtract(x, y)) == [-1, 2, -1] and one(scalar.dot(x, y)) == 14.0
    assert one(scalar.full(7, 3)) == [7, 7, 7] and one(scalar.identity(2)) == [[1, 0], [0, 1]]
    assert one(scalar.replace_item(x, 1, 9)) == [1, 9, 3] and one(scalar.replace_item(x, 9, 9)) == [1, 2, 3]
    assert one(F.array_prepend(x, 0)) == [0, 1, 2, 3]
    assert one(scalar.item(x, -1)) == 3 and one(scalar.item(x, 5)) is None and one(scalar.item(x, -5)) is None
    assert one(scalar.map_get(m, "z", 0)) == 0 and one(scalar.map_get(m, "z")) is None and one(scalar.map_get(m, "b")) == 2
    assert one(scalar.nth_key(m, F.lit(2))) == "b" and one(scalar.nth_key(m, F.lit(3))) is None and one(scalar.nth_key(m, F.lit(0))) is None
    assert one(F.map_concat(m, F.create_map(F.lit("c"), F.lit(3)))) == {"a": 1, "b": 2, "c": 3}
    assert one(F.map_filter(m, lambda k, v: v > 1)) == {"b": 2} and [tuple(e) for e in one(F.map_entries(m))] == [("a", 1), ("b", 2)]
    assert one(F.format_string("%2$s-%1$s", F.lit("a"), F.lit("b"))) == "b-a"
