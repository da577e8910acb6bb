"""Financial projections and catalogue reshaping (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simple_interest(df: DataFrame, principal: str, rate: str, years: str) -> DataFrame:
    """interest = p r t / 100 and total."""
    interest = F.col(principal) * F.col(rate) * F.col(years) / 100
    return df.withColumn("interest", interest).withColumn("total", F.col(principal) + F.col("interest"))


def compound_interest(df: DataFrame, principal: str, rate: str, years: str, frequency: str) -> DataFrame:
    """amount = p (1 + r / 100 / n) ** (n t) and the interest in it."""
    n = F.col(frequency)
    amount = F.col(principal) * F.pow(1 + F.col(rate) / 100 / n, n * F.col(years))
    return df.withColumn("amount", amount).withColumn("interest", F.col("amount") - F.col(principal))


def roi(initial: Column, final: Column) -> Column:
    """Return in percent; nothing invested gives null."""
    return F.try_divide(final - initial, initial) * 100


def format_money(amount: Column, label: str = "") -> Column:
    return F.format_string(f"{label}%.2f", amount)


def quote_price(df: DataFrame, payload: str, path: str = "$['Global Quote']['05. price']", default: str = "N/A") -> DataFrame:
    """The price text at a path of a JSON reply, ``price`` as number, and whether it is an error."""
    text = F.coalesce(F.get_json_object(F.col(payload), path), F.lit(default))
    return df.withColumn("price_text", text).withColumn("price", F.col("price_text").try_cast("double")).withColumn("is_error", F.col("price").isNull())


def convert_currency(df: DataFrame, rates: DataFrame, amount: str, source: str, target: str) -> DataFrame:
    """amount times the rate of (from, to); a missing rate marks an error."""
    side = rates.select(F.col("from_currency").alias("_f"), F.col("to_currency").alias("_t"), F.col("rate").alias("_rate")).dropDuplicates(["_f", "_t"])
    out = df.join(side, (df[source] == side["_f"]) & (df[target] == side["_t"]), "left")
    return out.withColumn("converted", F.col(amount) * F.col("_rate")).withColumn("is_error", F.col("_rate").isNull()).drop("_f", "_t", "_rate")


def flatten_catalogue(df: DataFrame, catalogue: str) -> DataFrame:
    """index -> list of lists of (name, symbol), to rows index, name, symbol."""
    rows = df.select(F.explode(catalogue).alias("index", "_lists"))
    return rows.select("index", F.explode(F.flatten("_lists")).alias("_s")).select("index", "_s.name", "_s.symbol")


def chunk_list(array: Column, size: int, pad: Column | None = None) -> Column:
    """An array in chunks of ``size``, the last one filled up with ``pad`` where it is given; an empty array has none."""
    count = F.ceil(F.size(array) / size).cast("int")
    starts = F.when(F.size(array) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    piece = lambda i: F.slice(array, i * size + 1, F.lit(size))
    if pad is None:
        return F.transform(starts, piece)
    return F.transform(starts, lambda i: F.concat(piece(i), F.array_repeat(pad, F.greatest(F.lit(0), F.lit(size) - F.size(piece(i))))))
