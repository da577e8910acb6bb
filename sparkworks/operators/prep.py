"""Missing data, encoding, scaling, binning and splitting (E, M1-M3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkworks.operators.ranges import modes, quantiles, with_position, with_rank_in
from sparkworks.operators.stats import hash_share, numeric_columns


def _check(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {missing}")


def fill_values(df: DataFrame, method: str, columns: Sequence[str]) -> dict[str, object]:
    """The value that fills each column; columns without any value are left out."""
    if method == "median":
        row = {r["column"]: r["q"][0] for r in quantiles(df, columns, (0.5,)).collect()}
        row = {c: row.get(c) for c in columns}
    else:
        row = (modes(df, columns) if method == "mode" else df.agg(*(F.avg(c).alias(c) for c in columns))).first()
    return {c: row[c] for c in columns if row[c] is not None}


def fill_missing(df: DataFrame, method: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls with the column's mean or median (numeric columns only) or mode (smallest of equals), or drop rows that have any."""
    if method not in ("mean", "median", "mode", "drop"):
        raise ValueError(f"unknown method {method!r}")
    _check(df, columns or [])
    if method == "drop":
        return df.na.drop(subset=list(columns) if columns else None)
    names = list(columns or df.columns)
    if method != "mode":
        names = [c for c in names if c in numeric_columns(df)]
    if not names:
        return df
    values = fill_values(df, method, names)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double") if method != "mode" else F.col(c), F.lit(v)) for c, v in values.items()})


def impute_fit(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians, to be reused on other rows."""
    _check(df, columns)
    return fill_values(df, "median", columns)


def impute_apply(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in medians.items()})


def drop_columns_with_nulls(df: DataFrame) -> DataFrame:
    row = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if row[c]))


def fill_split(df: DataFrame, column: str, key: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Fill nulls: ``share`` of them with the most common value and the rest with the least common, chosen by a hash of the key.

    The exact number is kept: the nulls' hashes are ranked over all partitions.
    """
    stats = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    values = stats.agg(F.min_by(column, F.struct(-F.col("n"), column)).alias("_most"), F.min_by(column, F.struct("n", column)).alias("_least"))
    missing = df.filter(F.col(column).isNull()).withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))))
    total = missing.agg(F.count("*").alias("_n"))
    placed = with_position(missing, ["_hash", key], "_at").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(values))
    filled = placed.withColumn(column, F.when(F.col("_at") < F.floor(F.col("_n") * share), F.col("_most")).otherwise(F.col("_least"))).select(*df.columns)
    return df.filter(F.col(column).isNotNull()).unionByName(filled)


def map_values(column: Column, mapping: dict) -> Column:
    """Recode; what has no entry becomes null."""
    out = None
    for k, v in mapping.items():
        out = F.when(column == F.lit(k), F.lit(v)) if out is None else out.when(column == F.lit(k), F.lit(v))
    return out if out is not None else F.lit(None)


def classes(df: DataFrame, column: str, most: int = 1000) -> list:
    """Sorted distinct values but null: a list for the driver, so more than ``most`` of them raise a ValueError."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"column {column} has more than {most} different values: too many for classes")
    return sorted(r[0] for r in found)


def label_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """A table of the sorted values and their codes from 0."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return with_position(values, [column], code)


def label_encode(df: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Codes 0..k-1 of the sorted values beside the column; null has code -1."""
    codes = label_codes(df, column, code or f"{column}_code")
    return df.join(codes, column, "left").withColumn(code or f"{column}_code", F.coalesce(F.col(code or f"{column}_code"), F.lit(-1)))


def label_decode(df: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    return df.join(codes, code, "left")


def ordinal_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = label_encode(df, c)
    return df


def one_hot(df: DataFrame, column: str, drop_first: bool = False) -> DataFrame:
    """A 0/1 column per sorted value, none dropped unless asked; the column itself goes. Null rows have zeros throughout."""
    values = classes(df, column)[1 if drop_first else 0 :]
    return df.select(*(c for c in df.columns if c != column), *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values))


def get_dummies(df: DataFrame, column: str, drop_first: bool = False) -> DataFrame:
    return one_hot(df, column, drop_first)


def scale_fit(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """(shift, width) per column: mean and population std, or least value and range; one pass."""
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown kind {kind!r}")
    pair = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
    row = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}:{k}") for c in columns for k, f in enumerate(pair))).first()
    return {c: (row[f"{c}:0"], row[f"{c}:1"]) for c in columns}


def scale_apply(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """A column without width becomes 0; null stays null."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(w) if w else F.col(c) * 0.0 for c, (m, w) in scales.items() if m is not None})


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return scale_apply(df, scale_fit(df, columns))


def minmax_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return scale_apply(df, scale_fit(df, columns, "minmax"))


def pixel_scale(column: Column) -> Column:
    return column / F.lit(255.0)


def cut(column: Column, bins: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bins (a, b]; outside them null; the last edge may be infinite."""
    if len(bins) != len(labels) + 1:
        raise ValueError("there must be one label fewer than edges")
    out = F.when(column.isNull() | (column <= F.lit(float(bins[0]))), F.lit(None))
    for edge, label in zip(bins[1:], labels, strict=True):
        out = out.when(column <= F.lit(float(edge)), F.lit(label))
    return out


def classify_rule(column: Column) -> Column:
    """low up to 4, medium from 5 to 6, high otherwise."""
    return F.when(column <= 4, "low").when((column >= 5) & (column <= 6), "medium").otherwise("high")


def ratio_features(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Quotients of columns; a zero denominator gives null."""
    return df.withColumns({name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in ratios.items()})


def transform_pipeline(df: DataFrame, label: str, ratios: dict[str, tuple[str, str]] | None = None, categorical: Sequence[str] = ()) -> tuple[PipelineModel, "PreparedColumns"]:
    """Fit ratios, exact median imputation, scaling and one-hot encoding; the result is applied with ``transform_apply``."""
    base = ratio_features(df, ratios or {})
    numeric = [c for c in numeric_columns(base) if c != label]
    medians = impute_fit(base, numeric)
    filled = impute_apply(base, medians)
    scales = scale_fit(filled, numeric)
    stages = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_index", stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_onehot", dropLast=False))
    stages.append(VectorAssembler(inputCols=[*numeric, *(f"{c}_onehot" for c in categorical)], outputCol="features"))
    prepared = PreparedColumns(ratios or {}, medians, scales)
    return Pipeline(stages=stages).fit(prepared.apply(df)), prepared


class PreparedColumns:
    """What was learned of the numeric columns."""

    def __init__(self, ratios: dict, medians: dict, scales: dict):
        self.ratios, self.medians, self.scales = ratios, medians, scales

    def apply(self, df: DataFrame) -> DataFrame:
        return scale_apply(impute_apply(ratio_features(df, self.ratios), self.medians), self.scales)


def transform_apply(df: DataFrame, fitted: tuple[PipelineModel, PreparedColumns]) -> DataFrame:
    model, prepared = fitted
    return model.transform(prepared.apply(df))


def sigmoid(column: Column) -> Column:
    return 1 / (1 + F.exp(-column))


def threshold(column: Column, at: float = 0.5) -> Column:
    """1 where a probability is above the threshold."""
    return (column > at).cast("int")


# --- splits -------------------------------------------------------------------


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 0, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by a hash of the key, without a shuffle; ``exact`` gives ceil(n * test_size) test rows by rank of the hash."""
    if not exact:
        share = hash_share(key, seed)
        return df.filter(share >= test_size), df.filter(share < test_size)
    placed = with_position(df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))), ["_hash", key], "_at")
    total = df.agg(F.ceil(F.count("*") * F.lit(test_size)).alias("_test"))
    placed = placed.crossJoin(F.broadcast(total))
    drop = ("_hash", "_at", "_test")
    return placed.filter("_at >= _test").drop(*drop), placed.filter("_at < _test").drop(*drop)


def stratified_split(df: DataFrame, key: str, stratum: str, test_size: float = 0.2, seed: int = 0) -> DataFrame:
    """Every row with ``is_test``: round(n * test_size) rows of each stratum, by rank of a hash of the key.

    Ranks are those of the whole table in order of stratum and hash, less the
    stratum's first, so a stratum with most rows does not meet in one task.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))))
    placed = with_rank_in(hashed, stratum, ["_hash", key], "_rank", size="_all")
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_rank") < F.round(F.col("_all") * test_size)).alias("is_test"))


def sequential_split(df: DataFrame, order: Sequence[str], ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first floor(n * ratio) rows in order, and the others."""
    total = df.agg(F.floor(F.count("*") * F.lit(ratio)).alias("_first"))
    placed = with_position(df, order, "_at").crossJoin(F.broadcast(total))
    return placed.filter("_at < _first").drop("_at", "_first"), placed.filter("_at >= _first").drop("_at", "_first")


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)
