"""Stateless JSON message streams (R1-R3).  All of them take batch frames as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkworks.operators.quality import required


def encode_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with ``value``: {"message": text} as JSON."""
    return df.select(F.to_json(F.struct(F.col(text).alias("message")), {"ignoreNullFields": "false"}).alias("value"))


def decode_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """The frame with ``message`` and ``is_malformed``: JSON that cannot be read, or that has no message."""
    parsed = F.from_json(F.col(value).cast("string"), "message string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = df.withColumn("_p", parsed)
    return rows.select(*(c for c in df.columns if c != value), F.col(value).cast("string").alias(value), F.col("_p.message").alias("message"), (F.col("_p").isNull() | F.col("_p._bad").isNotNull() | F.col("_p.message").isNull()).alias("is_malformed"))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(~F.col("is_malformed")).select("message")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.filter("is_malformed").select("value")


def validate_stream(df: DataFrame, text: str = "text", method: str | None = "method") -> DataFrame:
    """An ``error`` per row, null where it is fine: a missing or empty text, or a method other than POST."""
    wrong = F.when(~required(F.trim(F.col(text))) | F.col(text).isNull(), "empty text")
    if method is not None:
        wrong = F.when(F.coalesce(F.upper(method), F.lit("")) != "POST", "only POST is taken").otherwise(wrong)
    return df.withColumn("error", wrong)
