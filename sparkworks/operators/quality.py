"""Data-quality rules (V)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(column: Column) -> Column:
    """There is a value, and it is not empty."""
    return column.isNotNull() & (F.length(column.cast("string")) > 0)


def pattern(column: Column, regex: str) -> Column:
    """The text matches; null and empty texts pass, for they are the business of ``required``."""
    return column.isNull() | (column == "") | column.rlike(regex)


def max_length(column: Column, n: int) -> Column:
    return F.coalesce(F.length(column) <= n, F.lit(True))


def choices(column: Column, values: Sequence) -> Column:
    return F.coalesce(column.isin(list(values)), F.lit(True))


def not_null(column: Column) -> Column:
    return column.isNotNull()


def fields_match(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _passed(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def compose(df: DataFrame, rules: dict[str, Column], name: str = "failed") -> DataFrame:
    """An array of the names of the rules that each row fails; a rule that is null there is failed."""
    return df.withColumn(name, F.filter(F.array(*(F.when(~_passed(rule), F.lit(rule_name)) for rule_name, rule in rules.items())), lambda x: x.isNotNull()))


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Failures per rule, rules without any included; one pass.  A rule that is null for a row is failed there."""
    wide = df.agg(*(F.count_if(~_passed(rule)).alias(n) for n, rule in rules.items()))
    items = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("failures")) for n in rules))
    return wide.select(F.explode(items).alias("i")).select("i.*")
