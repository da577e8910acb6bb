"""Sources and sinks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A table with a header row; types are inferred only where no schema is given.

    Quoted fields may hold separators, doubled quotes and, with ``multi_line``,
    line ends (such files are not split).  ``NaN`` in floating columns becomes null.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values have one form, null."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(*(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns))


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """Export to a folder with one file per partition; no row index."""
    df.write.mode("overwrite").option("header", header).option("sep", sep).option("escape", '"').csv(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_text_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").text(path)


def parse_delimited_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Word-list lines: label (last field), name (first), and the two folders derived from the name.

    Lines that start with ``#`` and lines whose second field is ``err`` are left out.
    """
    fields = F.split(F.col(line), " ")
    parsed = df.filter(~F.col(line).startswith("#")).withColumn("fields", fields)
    parsed = parsed.filter(F.coalesce(F.get("fields", F.lit(1)) != "err", F.lit(True)))
    name = F.get("fields", F.lit(0))
    return parsed.withColumn("label", F.element_at("fields", -1)).withColumn("name", name).withColumn("folder1", F.substring(name, 1, 3)).withColumn("folder2", F.substring_index(name, "-", 2)).drop("fields")


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A database table; ``partition`` is (column, lower, upper, partitions) for a parallel read.  The driver jar is the user's."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if driver:
        reader = reader.option("driver", driver)
    if partition:
        column, lower, upper, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", n)
    return reader.load()


def from_rows(spark: SparkSession, rows: Sequence[dict] | dict[str, Sequence], schema: T.StructType | str) -> DataFrame:
    """A frame from a list of dicts or a dict of equally long lists."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if isinstance(rows, dict):
        rows = [dict(zip(rows, values, strict=True)) for values in zip(*rows.values(), strict=True)]
    return spark.createDataFrame([tuple(r.get(c) for c in kind.names) for r in rows], kind)


def range_table(spark: SparkSession, start: float, end: float, step: float | None = None, num: int | None = None, name: str = "x") -> DataFrame:
    """``start, start + step, ...`` below ``end``, or ``num`` evenly spaced values with both ends."""
    if (step is None) == (num is None):
        raise ValueError("give either step or num")
    if num is not None:
        by = (end - start) / (num - 1) if num > 1 else 0.0
        return spark.range(num).select((F.lit(float(start)) + F.col("id") * F.lit(by)).alias(name))
    return spark.range(max(0, math.ceil((end - start) / step))).select((F.lit(start) + F.col("id") * F.lit(step)).alias(name))


def random_bits(key: Column, seed: int, stream: int, half: int = 0) -> Column:
    """A number of 52 bits that depends on key, seed and stream alone: digits of an md5, of which ``half`` picks a part."""
    digest = F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)), F.lit(str(stream))))
    return F.conv(F.substring(digest, 1 + 13 * half, 13), 16, 10).cast("long")


def random_uniform(key: Column, seed: int, stream: int = 0) -> Column:
    """In [0, 1)."""
    return random_bits(key, seed, stream) / F.lit(float(1 << 52))


def random_normal(key: Column, seed: int, stream: int = 0) -> Column:
    """Standard normal, from two uniform numbers (Box and Muller)."""
    first = (random_bits(key, seed, stream) + F.lit(0.5)) / F.lit(float(1 << 52))
    second = random_bits(key, seed, stream, 1) / F.lit(float(1 << 52))
    return F.sqrt(-2 * F.log(first)) * F.cos(2 * math.pi * second)


def random_columns(df: DataFrame, key: str, columns: dict[str, tuple], seed: int = 0) -> DataFrame:
    """Seeded columns beside a key: ('uniform',), ('normal',) or ('integer', a, b) with values in [a, b).

    A value depends on key, seed and the column's place, however the rows are
    partitioned and whenever a task is run again.
    """
    out = {}
    for k, (name, (kind, *bounds)) in enumerate(columns.items()):
        if kind == "uniform":
            out[name] = random_uniform(F.col(key), seed, k)
        elif kind == "normal":
            out[name] = random_normal(F.col(key), seed, k)
        elif kind == "integer":
            out[name] = F.floor(random_uniform(F.col(key), seed, k) * (bounds[1] - bounds[0]) + bounds[0])
        else:
            raise ValueError(f"unknown kind {kind!r}")
    return df.withColumns(out)


def random_table(spark: SparkSession, n: int, columns: dict[str, tuple], seed: int = 0) -> DataFrame:
    """n rows with ids from 0 and ``random_columns``."""
    return random_columns(spark.range(n), "id", columns, seed)


def make_circles(spark: SparkSession, n: int, noise: float = 0.0, factor: float = 0.8, seed: int = 0) -> DataFrame:
    """Two concentric circles: n // 2 points on the outer (label 0), the others on the inner (label 1)."""
    outer = n // 2
    inner = F.col("id") >= outer
    turn = F.when(inner, (F.col("id") - outer) / F.lit(max(1, n - outer))).otherwise(F.col("id") / F.lit(max(1, outer))) * (2 * math.pi)
    radius = F.when(inner, F.lit(factor)).otherwise(F.lit(1.0))
    point = lambda f, k: f(turn) * radius + random_normal(F.col("id"), seed, k) * noise
    return spark.range(n).select("id", point(F.cos, 0).alias("X1"), point(F.sin, 1).alias("X2"), inner.cast("int").alias("label"))


def grid_table(x: DataFrame, y: DataFrame, value: Column | None = None) -> DataFrame:
    """The mesh of two axes (their sizes are the caller's), with a function of it as ``z``."""
    mesh = x.crossJoin(y)
    return mesh if value is None else mesh.withColumn("z", value)


def encode_json(df: DataFrame, text: Column, name: str = "message") -> DataFrame:
    """One JSON text per row in column ``value``."""
    return df.withColumn("value", F.to_json(F.struct(text.alias(name)), {"ignoreNullFields": "false"}))


def decode_json(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parsed columns beside the original; malformed text gives nulls in all of them."""
    kind = T.StructType.fromDDL(schema)
    parsed = F.from_json(F.col(column).cast("string"), kind)
    return df.withColumn("_json", parsed).select(*df.columns, *(F.col(f"_json.`{c}`").alias(c) for c in kind.names))


def kafka_options(servers: str, topic: str, write: bool) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic" if write else "subscribe": topic}


def kafka_json_sink(df: DataFrame, topic: str, servers: str, text: str = "text"):
    """A writer of ``{"message": text}`` rows to a topic; the connector jar is the user's."""
    rows = encode_json(df, F.col(text)).select("value")
    writer = rows.writeStream if df.isStreaming else rows.write
    return writer.format("kafka").options(**kafka_options(servers, topic, True))


def kafka_json_source(spark: SparkSession, topic: str, servers: str, schema: str = "message string") -> DataFrame:
    rows = spark.readStream.format("kafka").options(**kafka_options(servers, topic, False)).option("startingOffsets", "earliest").load()
    return decode_json(rows.select(F.col("value").cast("string").alias("value")), schema)


class _Texts(HTMLParser):
    """Texts of all elements with a tag and, where given, a class."""

    def __init__(self, tag: str, cls: str | None):
        super().__init__()
        self.tag, self.cls, self.depth, self.parts, self.found = tag, cls, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag != self.tag:
            return
        if self.depth:
            self.depth += 1
        elif self.cls is None or self.cls in (dict(attrs).get("class") or "").split():
            self.depth, self.parts = 1, []

    def handle_endtag(self, tag):
        if tag == self.tag and self.depth:
            self.depth -= 1
            if not self.depth:
                self.found.append("".join(self.parts).strip())

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def extract_elements(df: DataFrame, html: str, tag: str, cls: str | None = None, limit: int | None = None, prefix: str = "", out: str = "elements") -> DataFrame:
    """An array of the stripped texts of elements, the first ``limit`` of each page, each after ``prefix``."""

    @F.pandas_udf("array<string>")
    def texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in pages:
            rows = []
            for page in series:
                parser = _Texts(tag, cls)
                parser.feed(page or "")
                parser.close()
                rows.append(parser.found)
            yield pd.Series(rows)

    found = texts(F.col(html))
    if limit is not None:
        found = F.slice(found, 1, limit)
    return df.withColumn(out, F.transform(found, lambda x: F.concat(F.lit(prefix), x)))
