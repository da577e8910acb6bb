"""Queries on aggregation, profiling, preparation and splits (A, W, E, M1-M3)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkworks.operators import prep, stats
from sparkworks.operators.table import with_position
from sparkworks.plans.registry import query

#: orders with missing prices and priorities, as SQL and as a frame.
GAPS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders)"


def gaps(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"))


# --- aggregation --------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(q) AS q, count(l_tax) AS l_tax FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem) GROUP BY 1, 2")
def group_count(t):
    rows = t.lineitem.withColumn("q", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")))
    return stats.group_count(rows, ["l_returnflag", "l_linestatus"], ["q", "l_tax"])


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 20 GROUP BY 1")
def filtered_count(t):
    """The flagship: filter, count by group, sort."""
    rows = t.lineitem.filter((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 20))
    return stats.group_count(rows.select("l_returnflag", F.col("l_quantity").alias("n")), ["l_returnflag"])


@query(f"SELECT priority, count(*) AS count, round(count(*) * 1.0 / (SELECT count(*) FROM orders), 8) AS share FROM {GAPS} WHERE priority IS NOT NULL GROUP BY 1")
def value_counts(t):
    return stats.value_counts(gaps(t), "priority", normalize=True).withColumn("share", F.round("share", 8))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_tax")
    )
)
def describe(t):
    out = stats.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    return out.select("column", "count", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


@query(
    "SELECT 'o_orderpriority' AS \"column\", count(*) AS count, count(DISTINCT o_orderpriority) AS \"unique\", (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top, (SELECT count(*) FROM orders GROUP BY o_orderpriority ORDER BY 1 DESC LIMIT 1) AS freq FROM orders"
)
def describe_text(t):
    return stats.describe(t.orders, ["o_orderpriority"])


@query("SELECT round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_pop(l_extendedprice), 4) AS std, round(var_pop(l_extendedprice), 1) AS var, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(sum(l_extendedprice), 1) AS sum FROM lineitem")
def basic_stats(t):
    out = stats.basic_stats(t.lineitem, "l_extendedprice")
    return out.select(F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("std", 4).alias("std"), F.round("var", 1).alias("var"), "min", "max", F.round("sum", 1).alias("sum"))


@query("SELECT l_orderkey, l_linenumber, least(l_quantity, l_discount, l_tax) AS row_min, greatest(l_quantity, l_discount, l_tax) AS row_max FROM lineitem")
def row_minmax(t):
    return stats.row_min_max(t.lineitem, ["l_quantity", "l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "row_min", "row_max")


@query(f"SELECT 'price' AS \"column\", count(*) - count(price) AS nulls, count(price) AS non_nulls, count(*) AS rows FROM {GAPS} UNION ALL SELECT 'priority', count(*) - count(priority), count(priority), count(*) FROM {GAPS}")
def null_counts(t):
    return stats.null_counts(gaps(t), ["price", "priority"])


@query(f"SELECT (SELECT priority FROM {GAPS} WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, (SELECT priority FROM {GAPS} WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) AS least_common")
def mode_least(t):
    return stats.mode(gaps(t), "priority").crossJoin(stats.least_common(gaps(t), "priority"))


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem")
def col_means(t):
    return stats.column_means(t.lineitem, ["l_quantity", "l_discount"]).select(F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


@query("SELECT CAST(floor((rn - 1) / 1000) AS BIGINT) AS chunk, o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1, 2")
def chunk_counts(t):
    return stats.chunked_group_count(t.orders, ["o_orderstatus"], 1000, ["o_orderkey"])


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_vals(t):
    return stats.distinct_values(t.orders, "o_orderpriority")


_CORR = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM (SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice, l_discount FROM lineitem)" for a in _CORR for b in _CORR))
def corr_matrix(t):
    rows = t.lineitem.select(F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_discount")
    return stats.correlation(rows).withColumn("r", F.round("r", 6) + 0.0)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[:i]))
def corr_lower(t):
    return stats.lower_triangle(stats.correlation(t.lineitem, _CORR), _CORR).withColumn("r", F.round("r", 6) + 0.0)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) + 0.0 AS impact FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def feature_impact(t):
    return stats.feature_impact(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).withColumn("impact", F.round("impact", 6) + 0.0)


@query(
    "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 10) AS INTEGER), 9) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) "
    "SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 10, 4) AS low, round(lo + (i + 1) * (hi - lo) / 10, 4) AS high, coalesce(n, 0) AS n FROM b, range(10) r(i) LEFT JOIN c ON c.bin = i"
)
def histogram(t):
    return stats.histogram(t.lineitem, "l_extendedprice", 10).select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query("SELECT l_linestatus, count(*) AS count FROM lineitem GROUP BY 1")
def class_dist(t):
    return stats.value_counts(t.lineitem, "l_linestatus")


@query(f"SELECT l_returnflag, CAST(g AS DOUBLE) AS at, round(avg(exp(-power((g - l_quantity) / 2.0, 2) / 2) * {1 / (2.0 * math.sqrt(2 * math.pi))!r}), 8) AS density FROM lineitem, (VALUES (1.0), (10.0), (25.0), (40.0)) v(g) GROUP BY 1, 2")
def kde(t):
    return stats.kde(t.lineitem, "l_quantity", [1.0, 10.0, 25.0, 40.0], 2.0, "l_returnflag").withColumn("density", F.round("density", 8))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || md5(o_orderkey || '-3')[1:8])::BIGINT / 4294967296.0 < 0.1")
def scatter_sample(t):
    return stats.scatter_sample(t.orders, "o_orderkey", ["o_totalprice"], 0.1, seed=3)


_HASHED = "('0x' || md5(o_orderkey || '-{}')[1:8])::BIGINT / 4294967296.0"
_STRAT = "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '-1'), o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderpriority) * 0.2) AS is_test FROM orders"


@query(
    f"WITH s AS ({_STRAT}), o AS (SELECT o_orderpriority, count(*) * 1.0 / sum(count(*)) OVER () AS overall FROM orders GROUP BY 1), a AS (SELECT o_orderpriority, count(*) * 1.0 / sum(count(*)) OVER () AS stratified FROM s WHERE is_test GROUP BY 1), "
    f"b AS (SELECT o_orderpriority, count(*) * 1.0 / sum(count(*)) OVER () AS random FROM orders WHERE {_HASHED.format(2)} < 0.2 GROUP BY 1) SELECT o_orderpriority, round(overall, 6) AS overall, round(stratified, 6) AS stratified, round(random, 6) AS random, round(100 * stratified / overall - 100, 4) AS stratified_error, round(100 * random / overall - 100, 4) AS random_error FROM o FULL JOIN a USING (o_orderpriority) FULL JOIN b USING (o_orderpriority)"
)
def proportion_compare(t):
    strat = prep.stratified_split(t.orders, "o_orderkey", "o_orderpriority", 0.2, seed=1).filter("is_test")
    _, random = prep.train_test_split(t.orders, "o_orderkey", 0.2, seed=2)
    out = stats.proportion_compare(t.orders, strat, random, "o_orderpriority")
    return out.select("o_orderpriority", *(F.round(c, 6).alias(c) for c in ("overall", "stratified", "random")), *(F.round(c, 4).alias(c) for c in ("stratified_error", "random_error")))


@query("SELECT (SELECT string_agg(c, '' ORDER BY c) FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS c FROM part) WHERE c <> '') AS vocab, max(length(p_name)) AS max_len FROM part")
def vocab(t):
    return stats.vocab_and_max_len(t.part, "p_name")


@query(
    f"SELECT p_partkey, round(t, 6) AS t, round(p_size / sqrt(2) + p_retailprice * sin(t) + p_partkey * cos(t), 4) + 0.0 AS f FROM part, (SELECT CAST({-math.pi!r} AS DOUBLE) + i * CAST({2 * math.pi / 4!r} AS DOUBLE) AS t FROM range(5) r(i))"
)
def andrews(t):
    out = stats.andrews_curves(t.part.withColumn("k", F.col("p_partkey")), "p_partkey", ["p_size", "p_retailprice", "k"], 5)
    return out.select("p_partkey", F.round("t", 6).alias("t"), (F.round("f", 4) + 0.0).alias("f"))


@query("SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))")
def unpivot(t):
    return stats.parallel_coordinates(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0 AS z FROM lineitem")
def zscore(t):
    return stats.zscore(t.lineitem, "l_quantity").select("l_orderkey", "l_linenumber", (F.round("z", 6) + 0.0).alias("z"))


# --- preparation --------------------------------------------------------------


def _filled(method):
    def run(t):
        return prep.fill_missing(gaps(t), method, ["price"]).withColumn("price", F.round("price", 4))

    return run


for _name, _sql in (("mean", "avg(price)"), ("median", "median(price)")):
    _f = _filled(_name)
    _f.__name__ = f"fill_{_name}"
    query(f"SELECT o_orderkey, round(coalesce(price, (SELECT {_sql} FROM {GAPS})), 4) AS price, priority FROM {GAPS}")(_f)


@query(f"SELECT o_orderkey, coalesce(priority, (SELECT priority FROM {GAPS} WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM {GAPS}")
def fill_mode(t):
    return prep.fill_missing(gaps(t), "mode", ["priority"]).select("o_orderkey", "priority")


@query(f"SELECT * FROM {GAPS} WHERE price IS NOT NULL AND priority IS NOT NULL")
def drop_null(t):
    return prep.fill_missing(gaps(t), "drop")


@query(f"SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM {GAPS} WHERE o_orderkey % 4 <> 0)), 4) AS price FROM {GAPS}")
def impute_median(t):
    rows = gaps(t)
    medians = prep.impute_fit(rows.filter("o_orderkey % 4 <> 0"), ["price"])
    return prep.impute_apply(rows, medians).select("o_orderkey", F.round("price", 4).alias("price"))


@query(
    f"WITH g AS (SELECT * FROM {GAPS}), m AS (SELECT (SELECT priority FROM g WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most, (SELECT priority FROM g WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) AS least), "
    "n AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '-0'), o_orderkey) - 1 AS place, count(*) OVER () AS k FROM g WHERE priority IS NULL) "
    "SELECT o_orderkey, priority FROM g WHERE priority IS NOT NULL UNION ALL SELECT o_orderkey, CASE WHEN place < floor(k * 0.8) THEN most ELSE least END FROM n, m"
)
def fill_split(t):
    return prep.fill_split(gaps(t), "priority", "o_orderkey", 0.8).select("o_orderkey", "priority")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS v FROM orders")
def map_values(t):
    return t.orders.select("o_orderkey", prep.map_values(F.col("o_orderstatus"), {"F": 1, "O": 0}).alias("v"))


@query("SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_code FROM orders")
def label_encode(t):
    return prep.label_encode(t.orders, "o_orderpriority").select("o_orderkey", "o_orderpriority", "o_orderpriority_code")


@query(f"WITH g AS (SELECT * FROM {GAPS}), c AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS code FROM (SELECT DISTINCT priority FROM g WHERE priority IS NOT NULL)) SELECT o_orderkey, coalesce(code, -1) AS priority_code FROM g LEFT JOIN c USING (priority)")
def ordinal_encode(t):
    return prep.ordinal_encode(gaps(t), ["priority"]).select("o_orderkey", "priority_code")


@query("SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INTEGER) AS l_returnflag_A, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R FROM lineitem")
def one_hot(t):
    return prep.one_hot(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R FROM lineitem")
def dummies(t):
    return prep.get_dummies(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", drop_first=True)


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) + 0.0 AS l_extendedprice, CAST(0 AS DOUBLE) AS flat FROM lineitem")
def standard_scale(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", F.lit(5.0).alias("flat"))
    return prep.standard_scale(rows, ["l_extendedprice", "flat"]).withColumn("l_extendedprice", F.round("l_extendedprice", 6) + 0.0)


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 8) AS l_extendedprice FROM lineitem")
def minmax_scale(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return prep.minmax_scale(rows, ["l_extendedprice"]).withColumn("l_extendedprice", F.round("l_extendedprice", 8))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 255.0, 8) AS v FROM lineitem")
def div_scale(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(prep.pixel_scale(F.col("l_quantity")), 8).alias("v"))


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN NULL WHEN c_acctbal <= 1500 THEN 1 WHEN c_acctbal <= 3000 THEN 2 WHEN c_acctbal <= 4500 THEN 3 ELSE 4 END AS bin FROM customer")
def cut_bins(t):
    return t.customer.select("c_custkey", prep.cut(F.col("c_acctbal"), [0.0, 1500.0, 3000.0, 4500.0, math.inf], [1, 2, 3, 4]).alias("bin"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 4 THEN 'low' WHEN l_quantity >= 5 AND l_quantity <= 6 THEN 'medium' ELSE 'high' END AS quality FROM lineitem")
def rule_label(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", prep.classify_rule(F.col("l_quantity")).alias("quality"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0) + 0.0000001, 6) AS unit_price, round(l_tax / nullif(l_discount, 0) + 0.0000001, 6) AS tax_per_discount FROM lineitem")
def ratio_features(t):
    out = prep.ratio_features(t.lineitem, {"unit_price": ("l_extendedprice", "l_quantity"), "tax_per_discount": ("l_tax", "l_discount")})
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("unit_price") + 1e-7, 6).alias("unit_price"), F.round(F.col("tax_per_discount") + 1e-7, 6).alias("tax_per_discount"))


@query()
def transform_pipeline(t):
    """Ratios, imputation, scaling, one-hot encoding and assembly; the vectors are told by their length and sum."""
    from pyspark.ml.functions import vector_to_array

    rows = t.lineitem.select("l_quantity", F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("l_discount"), "l_extendedprice", "l_returnflag")
    fitted = prep.transform_pipeline(rows, "l_extendedprice", {"ratio": ("l_discount", "l_quantity")}, ["l_returnflag"])
    values = vector_to_array("features")
    return prep.transform_apply(rows, fitted).select("l_returnflag", F.size(values).alias("n"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 4).alias("s")).groupBy("l_returnflag", "n").agg(F.round(F.sum("s"), 1).alias("s"))


_PREPARED = (
    "r AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE WHEN l_linenumber <> 2 THEN l_discount END AS d, l_returnflag AS f FROM lineitem), x AS (SELECT *, d / nullif(q, 0) AS ratio FROM r), "
    "m AS (SELECT l_orderkey, l_linenumber, f, coalesce(q, (SELECT median(q) FROM x)) AS q, coalesce(d, (SELECT median(d) FROM x)) AS d, coalesce(ratio, (SELECT median(ratio) FROM x)) AS ratio FROM x)"
)


@query(f"WITH {_PREPARED} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) + 0.0 AS {c}" for c in ("q", "d", "ratio")) + ", CAST(f = 'A' AS DOUBLE) AS is_a, CAST(f = 'N' AS DOUBLE) AS is_n, CAST(f = 'R' AS DOUBLE) AS is_r, 6 + 1 AS size FROM m")
def transform_vectors(t):
    """The same pipeline, each vector's entries as columns; the last entry is that of values never seen."""
    from pyspark.ml.functions import vector_to_array

    rows = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.col("l_quantity").alias("q"), F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("d"), F.col("l_returnflag").alias("f"))
    fitted = prep.transform_pipeline(rows, "key", {"ratio": ("d", "q")}, ["f"])
    v = vector_to_array("features")
    out = prep.transform_apply(rows, fitted).select(F.split("key", "-").alias("k"), v.alias("v"))
    return out.select(F.col("k")[0].cast("long").alias("l_orderkey"), F.col("k")[1].cast("int").alias("l_linenumber"), *((F.round(F.col("v")[i], 5) + 0.0).alias(c) for i, c in enumerate(("q", "d", "ratio"))), *(F.col("v")[i].alias(c) for i, c in ((3, "is_a"), (4, "is_n"), (5, "is_r"))), F.size("v").alias("size"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 8) AS p, CAST(1 / (1 + exp(-(l_quantity - 25) / 10)) > 0.5 AS INTEGER) AS label FROM lineitem")
def sigmoid_threshold(t):
    p = prep.sigmoid((F.col("l_quantity") - 25) / 10)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(p, 8).alias("p"), prep.threshold(p).alias("label"))


# --- splits -------------------------------------------------------------------


@query(f"SELECT o_orderkey, {_HASHED.format(2)} < 0.2 AS is_test FROM orders")
def hash_split(t):
    train, test = prep.train_test_split(t.orders.select("o_orderkey"), "o_orderkey", 0.2, seed=2)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '-2'), o_orderkey) <= ceil(count(*) OVER () * 0.3) AS is_test FROM orders")
def exact_split(t):
    train, test = prep.train_test_split(t.orders.select("o_orderkey"), "o_orderkey", 0.3, seed=2, exact=True)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query(_STRAT)
def strat_split(t):
    return prep.stratified_split(t.orders, "o_orderkey", "o_orderpriority", 0.2, seed=1).select("o_orderkey", "o_orderpriority", "is_test")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.8) AS is_train FROM orders")
def seq_split(t):
    train, test = prep.sequential_split(t.orders.select("o_orderkey"), ["o_orderkey"], 0.8)
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'F'")
def reset_index(t):
    return with_position(t.orders.filter("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"])
