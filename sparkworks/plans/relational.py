"""Queries on sources, projection, filters, joins, order, set operations and records (S, P, F, J, L, U, C, V)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkworks.operators import quality, table
from sparkworks.operators.ranges import shared_folder
from sparkworks.operators.stats import value_counts
from sparkworks.plans.registry import query
from sparkworks.sources import io
from sparkworks.streaming import messages, sinks


def _scratch(t) -> str:
    """A fresh path in the folder that the cluster shares."""
    root = shared_folder(t.spark)
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


# --- sources and sinks --------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders")
def csv_roundtrip(t):
    path = _scratch(t)
    io.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), path, sep=";")
    back = io.read_csv(t.spark, path, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double", sep=";", multi_line=False)
    return back.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM documents), w AS (SELECT *, string_split(line, ' ') AS f FROM l) "
    "SELECT doc_id, line_no, f[len(f)] AS label, f[1] AS name, f[1][1:3] AS folder1, array_to_string(string_split(f[1], '-')[1:2], '-') AS folder2 FROM w WHERE NOT starts_with(line, '#') AND coalesce(f[2] <> 'err', true)"
)
def line_parse(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return io.parse_delimited_lines(lines, "line").select("doc_id", "line_no", "label", "name", "folder1", "folder2")


@query("SELECT i AS id, round(i * (1.0 / (n - 1)), 6) AS x FROM (SELECT l_linenumber + 0 AS k, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS n FROM lineitem)")
def linspace(t):
    n = t.lineitem.count()
    return io.range_table(t.spark, 0.0, 1.0, num=n).select(F.round(F.col("x") * (n - 1)).cast("long").alias("id"), F.round("x", 6).alias("x"))


@query("SELECT a.p_size AS x, b.r_regionkey AS y, CAST(a.p_size * a.p_size + b.r_regionkey AS BIGINT) AS z FROM (SELECT DISTINCT p_size FROM part) a CROSS JOIN region b")
def grid_eval(t):
    x, y = t.part.select(F.col("p_size").alias("x")).distinct(), t.region.select(F.col("r_regionkey").alias("y"))
    return io.grid_table(x, F.broadcast(y), (F.col("x") * F.col("x") + F.col("y")).cast("long"))


@query("""SELECT event_id, '{"message":' || to_json(event_type) || '}' AS value FROM events""")
def json_encode(t):
    return io.encode_json(t.events, F.col("event_type")).select("event_id", "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(t):
    return io.decode_json(t.events, "k long", "props").select("event_id", "k")


@query("SELECT event_id, event_type AS message FROM events WHERE event_id % 7 <> 0")
def message_ingest(t):
    broken = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_type").alias("message"))))
    decoded = messages.decode_messages(t.events.select("event_id", broken.alias("value")))
    return decoded.filter(~F.col("is_malformed")).select("event_id", "message")


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS side, CASE WHEN event_id % 7 = 0 THEN '{broken ' || event_id ELSE event_type END AS text, count(*) AS n FROM events GROUP BY 1, 2")
def stream_split(t):
    """Events as a stream of JSON messages, some broken, written by batch to two sinks and read back."""
    folder = _scratch(t)
    # A pattern, for a table may be one file or a folder of them.
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]")
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("message"))))
    sink = sinks.SplitSink(folder, ~F.col("is_malformed"))
    sink.start(messages.decode_messages(source.select(broken.alias("value"))), f"{folder}/checkpoint").awaitTermination()
    sides = [sink.read(t.spark, side).select(F.lit(side).alias("side"), F.coalesce("message", "value").alias("text")) for side in ("accepted", "rejected")]
    return table.concat_rows(sides).groupBy("side", "text").agg(F.count("*").alias("n"))


@query(
    "SELECT o_orderkey, ('0x' || md5(o_orderkey || '-5-0')[1:13])::BIGINT / 4503599627370496.0 AS u, round(sqrt(-2 * ln((('0x' || md5(o_orderkey || '-5-1')[1:13])::BIGINT + 0.5) / 4503599627370496.0)) * cos(2 * pi() * (('0x' || md5(o_orderkey || '-5-1')[14:26])::BIGINT / 4503599627370496.0)), 9) + 0.0 AS z, "
    "CAST(floor(('0x' || md5(o_orderkey || '-5-2')[1:13])::BIGINT / 4503599627370496.0 * 6 + 1) AS BIGINT) AS die FROM orders"
)
def random_columns(t):
    out = io.random_columns(t.orders.select("o_orderkey"), "o_orderkey", {"u": ("uniform",), "z": ("normal",), "die": ("integer", 1, 7)}, seed=5)
    return out.withColumn("z", F.round("z", 9) + 0.0)


_TURN = "(CASE WHEN i >= n // 2 THEN (i - n // 2) * 1.0 / (n - n // 2) ELSE i * 1.0 / (n // 2) END) * 2 * pi()"
_NOISE = "0.1 * sqrt(-2 * ln((('0x' || md5(i || '-3-{0}')[1:13])::BIGINT + 0.5) / 4503599627370496.0)) * cos(2 * pi() * (('0x' || md5(i || '-3-{0}')[14:26])::BIGINT / 4503599627370496.0))"


@query(f"SELECT i AS id, round(cos({_TURN}) * r + {_NOISE.format(0)}, 7) + 0.0 AS X1, round(sin({_TURN}) * r + {_NOISE.format(1)}, 7) + 0.0 AS X2, label FROM (SELECT *, CAST(i >= n // 2 AS INTEGER) AS label, CASE WHEN i >= n // 2 THEN 0.8 ELSE 1.0 END AS r FROM (SELECT count(*) OVER () AS n, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders))")
def circles(t):
    """As many points as there are orders."""
    out = io.make_circles(t.spark, t.orders.count(), noise=0.1, factor=0.8, seed=3)
    return out.select("id", (F.round("X1", 7) + 0.0).alias("X1"), (F.round("X2", 7) + 0.0).alias("X2"), "label")


@query("SELECT page_id, len(regexp_extract_all(html, '<a[ >]')) AS n_links FROM pages")
def html_links(t):
    return t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<a[ >])"), F.lit(1))).cast("long").alias("n_links"))


_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g'))"


@query(f"SELECT page_id, CASE WHEN contains(html, '<title>') THEN '* ' || {_TITLE} END AS title, CAST(len(regexp_extract_all(html, '<li[ >]')) AS INTEGER) AS n_items FROM pages")
def html_elements(t):
    """Titles and list items by the parser; the pages nest neither, so a pattern finds the same."""
    titles = io.extract_elements(t.pages, "html", "title", limit=1, prefix="* ", out="titles")
    return io.extract_elements(titles, "html", "li", out="items").select("page_id", F.get("titles", F.lit(0)).alias("title"), F.size("items").alias("n_items"))


@query("SELECT s AS status, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = s AND o_totalprice > 50000) AS found FROM (SELECT DISTINCT substring(n_name, 1, 1) AS s FROM nation)")
def exists_scalar(t):
    """Whether any order has a status and a price, for each letter that a nation begins with."""
    letters = [r[0] for r in t.nation.select(F.substring("n_name", 1, 1)).distinct().collect()]
    found = [(x, table.exists(t.orders, (F.col("o_orderstatus") == x) & (F.col("o_totalprice") > 50000))) for x in letters]
    return t.spark.createDataFrame(found, "status string, found boolean")


@query()
def html_paragraphs(t):
    """The first five paragraphs of each page, by a parser that minds nesting; SQL has none."""
    return io.extract_elements(t.pages, "html", "p", limit=5, prefix="- ").select("page_id", F.array_join("elements", "\n").alias("paragraphs"), F.size("elements").alias("n"))


# --- projection ---------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def project(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def drop_cols(t):
    return t.customer.drop("c_acctbal")


@query("SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END, 0) + l_extendedprice + l_tax, 4) AS total FROM lineitem")
def row_sum(t):
    rows = t.lineitem.withColumn("q", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")))
    return table.row_sum(rows, ["q", "l_extendedprice", "l_tax"]).select("l_orderkey", "l_linenumber", F.round("total", 4).alias("total"))


@query("SELECT p_partkey, p_retailprice, p_name, p_brand, p_type, p_size FROM part")
def reorder(t):
    return table.reorder_columns(t.part, "p_retailprice", 1)


@query(
    "SELECT 'c_custkey' AS \"column\", 'bigint' AS dtype, count(c_custkey) AS non_null FROM customer UNION ALL SELECT 'c_name', 'string', count(c_name) FROM customer "
    "UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', 'double', count(c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment) FROM customer"
)
def info(t):
    return table.info(t.customer)


@query("SELECT s_suppkey, s_name AS supplier_name, s_nationkey, s_acctbal, 'active' AS status FROM supplier")
def schema_evolve(t):
    return table.add_column_with_default(table.rename_column(t.supplier, "s_name", "supplier_name"), "status", "active")


@query("""SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_brand":' || to_json(p_brand) || ',"p_size":' || p_size || '}' AS json FROM part""")
def serialize_json(t):
    return table.serialize(t.part, ["p_partkey", "p_brand", "p_size"]).select("p_partkey", "json")


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT) AS v FROM orders")
def cast_num(t):
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return table.cast_column(t.orders.select("o_orderkey", text.alias("v")), "v", "bigint")


@query("SELECT 'bigint' AS key_type, 'string' AS status_type, 'double' AS price_type, count(*) AS n FROM orders")
def typeof(t):
    return t.orders.agg(F.first(F.expr("typeof(o_orderkey)")).alias("key_type"), F.first(F.expr("typeof(o_orderstatus)")).alias("status_type"), F.first(F.expr("typeof(o_totalprice)")).alias("price_type"), F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'BIG' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def cond_update(t):
    return table.set_where(t.orders, F.col("o_totalprice") > 100000, {"o_orderstatus": "BIG", "o_orderpriority": "X"}).select("o_orderkey", "o_orderstatus", "o_orderpriority")


# --- filters ------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t):
    return t.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 20")
def filter_and(t):
    return t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount > 0.05")
def filter_gt(t):
    return t.lineitem.filter(F.col("l_discount") > 0.05).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT o_orderkey, p, s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) WHERE p IS NULL OR s IS NULL")
def rows_with_null(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("p"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("s"))
    return rows.filter(table.any_null(rows))


@query("SELECT l_orderkey, l_linenumber, l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_quantity = 10 AS eq, l_quantity <> 10 AS ne, l_quantity > 10 AS gt, NOT (l_quantity >= 10 AND l_tax > 0.02) AS nand FROM lineitem")
def compare(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", (q < 10).alias("lt"), (q <= 10).alias("le"), (q == 10).alias("eq"), (q != 10).alias("ne"), (q > 10).alias("gt"), (~((q >= 10) & (F.col("l_tax") > 0.02))).alias("nand"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def icontains(t):
    return table.icontains(t.part, "p_name", "AN").select("p_partkey", "p_name")


@query("SELECT * EXCLUDE (o_orderdate) FROM orders WHERE o_orderkey = 42")
def pk_lookup(t):
    return table.pk_lookup(t.orders, "o_orderkey", 42).drop("o_orderdate")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def exists(t):
    big = t.orders.filter(F.col("o_totalprice") > 100000).select(F.col("o_custkey").alias("c_custkey"))
    return table.semi_existing(t.customer, big, "c_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def filter_even(t):
    return t.orders.filter(F.col("o_orderkey") % 2 == 0).select("o_orderkey")


# --- joins --------------------------------------------------------------------


@query(
    "WITH a AS (SELECT o_orderpriority AS k, count(*) AS n_all FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1) SELECT k, n_all, n_f FROM a FULL JOIN b USING (k)"
)
def align_props(t):
    count = lambda df, name: df.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias(name))
    return table.align_on_key([count(t.orders, "n_all"), count(t.orders.filter("o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'"), "n_f")], "k")


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey")
def lookup_join(t):
    return table.lookup(t.customer, t.nation.filter("n_nationkey % 4 <> 0"), "c_nationkey", "n_nationkey", "n_name", "unknown", "nation").select("c_custkey", "nation")


@query("SELECT p_partkey, first_part FROM part JOIN (SELECT p_brand, min(p_partkey) AS first_part FROM part GROUP BY 1) USING (p_brand)")
def reverse_lookup(t):
    dim = t.part.select("p_brand", F.col("p_partkey").alias("first_part"), F.col("p_partkey").alias("pos"))
    return table.reverse_lookup(t.part, dim, "p_brand", "first_part", "pos").select("p_partkey", "first_part")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey <= 2)")
def anti_join(t):
    taken = t.orders.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    rest = table.reject_existing(t.customer, taken, ["c_custkey"])
    return table.reject_existing(rest, t.customer.filter("c_custkey <= 2"), ["c_mktsegment"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(t):
    return table.semi_existing(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 50000 THEN 'F' ELSE 'O' END AS pred FROM orders")
def attach_pred(t):
    pred = t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 50000, "F").otherwise("O").alias("pred"))
    return table.hstack_by_key([t.orders.select("o_orderkey", "o_orderstatus"), pred], "o_orderkey")


# --- order --------------------------------------------------------------------


@query("SELECT o_orderkey, p, row_number() OVER (ORDER BY p ASC NULLS LAST, o_orderkey DESC) AS rn FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders) ORDER BY rn LIMIT 1000")
def sort_mixed(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("p"))
    top = table.sort_values(rows, ["p", "o_orderkey"], [True, False]).limit(1000)
    from pyspark.sql import Window

    # A thousand rows are left.
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.col("p").asc_nulls_last(), F.desc("o_orderkey"))))


@query("SELECT o_orderkey, p, row_number() OVER (ORDER BY p ASC NULLS LAST, o_orderkey DESC) AS rn FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)")
def sort_mixed_all(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("p"))
    placed = table.with_position(rows, ["p", "o_orderkey"], ascending=[True, False], nulls_last=True)
    return placed.select("o_orderkey", "p", (F.col("position") + 1).alias("rn"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def head(t):
    return table.head(t.orders, 10, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def tail(t):
    return table.tail(t.orders, 10, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) WHERE position BETWEEN 100 AND 199")
def slice_rows(t):
    return table.slice_rows(t.orders, 100, 200, ["o_orderkey"]).select("o_orderkey", "position")


@query("SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders) WHERE position BETWEEN n // 2 AND n // 2 + 99")
def deep_slice(t):
    """A hundred rows from the middle of the table by falling price."""
    middle = t.orders.count() // 2
    return table.slice_by_position(t.orders, middle, middle + 99, ["o_totalprice", "o_orderkey"], ascending=[False, True]).select("o_orderkey", "position")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders")
def position(t):
    return table.with_position(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "position")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 25")
def nsmallest(t):
    return table.nsmallest(t.part, 25, "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '-7'), o_orderkey) - 1 AS place FROM orders")
def shuffle_hash(t):
    return table.shuffle_rows(t.orders, "o_orderkey", 7, name="place").select("o_orderkey", "place")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS arg_max, CAST(list_position(embedding, list_min(embedding)) - 1 AS BIGINT) AS arg_min FROM embeddings")
def argmax(t):
    return t.embeddings.select("vec_id", table.argmax(F.col("embedding")).cast("long").alias("arg_max"), table.argmin(F.col("embedding")).cast("long").alias("arg_min"))


# --- set operations -----------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_all(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return table.concat_rows([a, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))])


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return table.distinct_rows([t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation"))])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def isin(t):
    return table.membership(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


# --- rules --------------------------------------------------------------------


@query("SELECT c_custkey, coalesce(length(n) > 0, false) AS ok FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END AS n FROM customer)")
def rule_required(t):
    name = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 5 == 1, "").otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", name.alias("n")).select("c_custkey", F.coalesce(quality.required(F.col("n")), F.lit(False)).alias("ok"))


@query("SELECT c_custkey, c IS NULL OR c = '' OR regexp_matches(c, '^[0-9]{4,8}$') AS ok FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS c FROM customer)")
def rule_pattern(t):
    code = F.when(F.col("c_custkey") % 6 == 0, None).when(F.col("c_custkey") % 6 == 1, "").otherwise(F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", code.alias("c")).select("c_custkey", quality.pattern(F.col("c"), "^[0-9]{4,8}$").alias("ok"))


@query("SELECT 'amount' AS rule, count(*) FILTER (WHERE c_acctbal < 0) AS failures FROM customer UNION ALL SELECT 'code', count(*) FILTER (WHERE NOT regexp_matches(CAST(c_custkey AS VARCHAR), '^[0-9]{3,8}$')) FROM customer UNION ALL SELECT 'segment', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer")
def rule_report(t):
    rules = {"amount": F.col("c_acctbal") >= 0, "code": quality.pattern(F.col("c_custkey").cast("string"), "^[0-9]{3,8}$"), "segment": quality.choices(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])}
    return quality.rule_report(t.customer, rules)


@query("SELECT p_partkey, length(p_name) <= 12 AS ok FROM part")
def rule_length(t):
    return t.part.select("p_partkey", quality.max_length(F.col("p_name"), 12).alias("ok"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END IS NOT DISTINCT FROM CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'F' END AS ok FROM orders")
def fields_match(t):
    a, b = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 6 != 0, F.lit("F"))
    return t.orders.select("o_orderkey", quality.fields_match(a, b).alias("ok"))


# --- records ------------------------------------------------------------------


@query("SELECT * FROM nation")
def list_all(t):
    return t.nation


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST((SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_name) AS INTEGER), n_name FROM nation")
def insert_rows(t):
    return table.insert_rows(t.region, t.nation.select(F.col("n_name").alias("r_name")), "r_regionkey", ["r_name"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def upsert(t):
    changes = t.supplier.filter("s_suppkey % 3 = 0").select("s_suppkey", F.lit("renamed").alias("s_name"), F.lit(None).cast("double").alias("s_acctbal"))
    return table.update_rows(t.supplier, changes, "s_suppkey")


@query("SELECT * FROM supplier WHERE s_suppkey % 4 <> 0")
def delete_keys(t):
    return table.delete_rows(t.supplier, t.supplier.filter("s_suppkey % 4 = 0"), "s_suppkey")


@query("SELECT p_brand, count(*) AS count FROM part GROUP BY 1")
def list_brands(t):
    return value_counts(t.part, "p_brand")
