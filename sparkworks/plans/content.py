"""Queries on text, retrieval, finance and scalar functions (T, B, X)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkworks.functions import arrays, scalar
from sparkworks.operators import finance, models, text
from sparkworks.operators.ranges import shared_folder
from sparkworks.plans.registry import query

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: DuckDB's \\w is ASCII, so the classes are written out.
TERMS = f"SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{2,}}')) AS term FROM documents) WHERE term NOT IN ({_STOP})"
_WEIGHTS = (
    f"terms AS ({TERMS}), tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), top AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 1000), "
    "raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN top USING (term)), "
    "weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"
)
#: The same with the reference's number of terms.
_ALL_WEIGHTS = _WEIGHTS.replace("LIMIT 1000)", "LIMIT 10000)")


# --- text ---------------------------------------------------------------------


@query(f"SELECT doc_id, term, count(*) AS tf FROM ({TERMS}) GROUP BY 1, 2")
def token_counts(t):
    return text.term_counts(t.documents, "doc_id", "text")


@query(f"WITH {_WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf(t):
    return text.tfidf(t.documents, "doc_id", "text", 1000).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_WEIGHTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS k FROM weights) SELECT doc_id, string_agg(term, ' ' ORDER BY k) AS keywords FROM r WHERE k <= 2 GROUP BY 1")
def top_keywords(t):
    weights = text.tfidf(t.documents, "doc_id", "text", 1000).withColumn("weight", F.round("weight", 9))
    return text.top_keywords(weights, "doc_id", 2)


@query(f"WITH {_ALL_WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_10000(t):
    return text.tfidf(t.documents, "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query(f"WITH {_ALL_WEIGHTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS k FROM weights) SELECT doc_id, string_agg(term, ' ' ORDER BY k) AS keywords FROM r WHERE k <= 2 GROUP BY 1")
def top_keywords_10000(t):
    weights = text.tfidf(t.documents, "doc_id", "text").withColumn("weight", F.round("weight", 9))
    return text.top_keywords(weights, "doc_id", 2)


_LEARNED = (
    f"terms AS ({TERMS}), tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), train AS (SELECT * FROM tf WHERE doc_id % 5 <> 0), top AS (SELECT term, count(*) AS df FROM train GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 10000), "
    "raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0)) / (1 + df)) + 1) AS w FROM tf JOIN top USING (term) WHERE doc_id % 5 = 0)"
)


@query(f"WITH {_LEARNED} SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw")
def tfidf_unseen(t):
    """Learned on four fifths of the documents, saved, loaded and applied to the others."""
    model = text.tfidf_fit(t.documents.filter("doc_id % 5 <> 0"), "doc_id", "text")
    loaded = text.TfidfModel.load(t.spark, model.save(f"{shared_folder(t.spark).rstrip('/')}/tfidf-{uuid.uuid4().hex}"))
    return loaded.transform(t.documents.filter("doc_id % 5 = 0"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query(f"SELECT DISTINCT term FROM ({TERMS})")
def vocab_terms(t):
    return text.vocabulary(text.tokenize(t.documents, "doc_id", "text"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)")
def chunk_fixed(t):
    return text.chunk_fixed(t.documents, "doc_id", "text", 1000, 200)


@query()
def chunk_text(t):
    """Chunks at paragraph, line and word ends; SQL has no such splitter."""
    return text.chunk_text(t.documents, "doc_id", "text").select("doc_id", "chunk_no", F.length("chunk").alias("n"), F.md5("chunk").alias("md5"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def concat_turns(t):
    return text.concat_pages(t.conversations, "conv_id", "turn", "text")


_NORM = "sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding]))"


@query(f"SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) / {_NORM} for x in embedding]), 6) + 0.0 AS s, round(CAST(embedding[1] AS DOUBLE) / {_NORM}, 6) + 0.0 AS first FROM embeddings")
def l2_normalize(t):
    out = text.l2_normalize(t.embeddings, "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", (F.round(total, 6) + 0.0).alias("s"), (F.round(F.get("embedding", F.lit(0)), 6) + 0.0).alias("first"))


_NEAR = (
    "q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
    "d AS (SELECT q, vec_id, label, list_distance(q.e, p.e) AS distance FROM q CROSS JOIN p), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS rank FROM d)"
)


def _queries(t):
    return t.embeddings.filter("vec_id % 20 = 0")


@query(f"WITH {_NEAR} SELECT q AS query_vec_id, vec_id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_topk(t):
    return text.knn_join(_queries(t), t.embeddings, 5, "vec_id", "vec_id", "embedding").withColumn("distance", F.round("distance", 5))


@query(f"WITH {_NEAR} SELECT q AS query_vec_id, vec_id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4")
def vector_topk(t):
    return text.similarity_search(t.embeddings, _queries(t)).withColumn("distance", F.round("distance", 5))


@query(f"WITH {_NEAR}, v AS (SELECT q, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY 1, 2) SELECT q AS query_vec_id, arg_min(label, (-n, label)) AS pred FROM v GROUP BY 1")
def knn_classify(t):
    return models.knn_classify(t.embeddings, _queries(t), 5, "vec_id", "embedding", "label")


@query(f"WITH {_NEAR} SELECT q AS query_vec_id, round(avg(label), 6) AS pred FROM r WHERE rank <= 3 GROUP BY 1")
def knn_regress(t):
    return models.knn_regress(t.embeddings, _queries(t), 3, "vec_id", "embedding", "label").withColumn("pred", F.round("pred", 6))


@query(f"WITH {_NEAR} SELECT CAST(rank AS INTEGER) AS rank, round(avg(distance), 5) AS mean_distance FROM r WHERE rank <= 6 GROUP BY 1")
def k_distance(t):
    return models.k_distance(t.embeddings, _queries(t), 6, "vec_id", "embedding").withColumn("mean_distance", F.round("mean_distance", 5))


@query()
def vector_topk_approx(t):
    """Four near vectors of each query through the inverted index; the tests hold its recall against the exact search."""
    return text.build_index(t.embeddings, "vec_id", "embedding").search(_queries(t), 4, "vec_id", "embedding", "vec_id").withColumn("distance", F.round("distance", 5))


_CELLS = "cells AS (SELECT vec_id AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, unnest(embedding) AS v FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings)"


def _cells(t):
    """The vectors as a matrix; their ids number them."""
    return arrays.from_rows(t.embeddings, "vec_id", "embedding", (t.embeddings.count(), 64))


@query(f"WITH {_CELLS} SELECT (i0 * 64 + i1) // 16 AS i0, (i0 * 64 + i1) // 4 % 4 AS i1, (i0 * 64 + i1) % 4 AS i2, v FROM cells")
def array_reshape(t):
    return arrays.reshape(_cells(t), (-1, 4, 4)).cells


@query(f"WITH {_CELLS} SELECT i1 AS i0, i0 AS i1, v FROM cells")
def array_transpose(t):
    return arrays.transpose(_cells(t)).cells


@query(f"WITH {_CELLS}, side AS (SELECT i0, i1, v FROM cells UNION ALL SELECT i0, i1 + 64, CAST(1 AS FLOAT) FROM cells WHERE i1 < 2) SELECT i0, i1, v FROM side UNION ALL SELECT i0 + n, i1, v FROM side, n")
def array_stack(t):
    """The vectors beside two columns of ones, and all of it twice, one below the other."""
    a = _cells(t)
    ones = arrays.ones(t.spark, (a.shape[0], 2))
    side = arrays.hstack([a, arrays.CellArray(ones.cells.withColumn("v", F.col("v").cast("float")), ones.shape)])
    return arrays.vstack([side, side]).cells


@query("SELECT doc_id, array_to_string(['- ' || x for x in string_split(text, chr(10))], chr(10)) AS bullets FROM documents")
def bullet_join(t):
    return t.documents.select("doc_id", text.bullet_join(F.split("text", "\n")).alias("bullets"))


# --- finance ------------------------------------------------------------------

_LOAN = "(SELECT c_custkey, abs(c_acctbal) AS p, CAST(c_nationkey % 12 + 1 AS DOUBLE) AS r, CAST(c_custkey % 5 + 1 AS DOUBLE) AS y, CAST(c_custkey % 3 + 1 AS INTEGER) AS n FROM customer)"


def _loans(t):
    return t.customer.select("c_custkey", F.abs("c_acctbal").alias("p"), (F.col("c_nationkey") % 12 + 1).cast("double").alias("r"), (F.col("c_custkey") % 5 + 1).cast("double").alias("y"), (F.col("c_custkey") % 3 + 1).cast("int").alias("n"))


@query(f"SELECT c_custkey, round(p * r * y / 100, 4) AS interest, round(p + p * r * y / 100, 4) AS total FROM {_LOAN}")
def simple_interest(t):
    return finance.simple_interest(_loans(t), "p", "r", "y").select("c_custkey", F.round("interest", 4).alias("interest"), F.round("total", 4).alias("total"))


@query(f"SELECT c_custkey, round(p * power(1 + r / 100 / n, n * y), 4) AS amount, round(p * power(1 + r / 100 / n, n * y) - p, 4) AS interest FROM {_LOAN}")
def compound_interest(t):
    # Scaled in doubles and then rounded, as the SQL does; F.round rounds the shortest decimal of a double and differs at ties.
    return finance.compound_interest(_loans(t), "p", "r", "y", "n").select("c_custkey", *((F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c) for c in ("amount", "interest")))


@query("SELECT l_orderkey, l_linenumber, round((l_tax - l_discount) / nullif(l_discount, 0) * 100, 6) AS roi FROM lineitem")
def roi(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(finance.roi(F.col("l_discount"), F.col("l_tax")), 6).alias("roi"))


@query("SELECT c_custkey, printf('Total: %.2f', c_acctbal) AS summary FROM customer")
def format_money(t):
    return t.customer.select("c_custkey", finance.format_money(F.col("c_acctbal"), "Total: ").alias("summary"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END, 'N/A') AS price_text, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS price, event_id % 4 = 0 AS is_error FROM events")
def json_path(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 4 == 0, "{}").otherwise(F.col("props")).alias("props"))
    return finance.quote_price(rows, "props", "$.k").select("event_id", "price_text", "price", "is_error")


@query("SELECT o_orderkey, round(o_totalprice * rate, 4) AS converted, rate IS NULL AS is_error FROM orders LEFT JOIN (VALUES ('F', 'USD', 1.1), ('O', 'USD', 0.9)) r(f, t, rate) ON o_orderstatus = f")
def fx_convert(t):
    rates = t.spark.createDataFrame([("F", "USD", 1.1), ("O", "USD", 0.9), ("O", "EUR", 2.0)], "from_currency string, to_currency string, rate double")
    out = finance.convert_currency(t.orders.withColumn("target", F.lit("USD")), rates, "o_totalprice", "o_orderstatus", "target")
    return out.select("o_orderkey", F.round("converted", 4).alias("converted"), "is_error")


@query("SELECT c_mktsegment AS \"index\", c_name AS name, CAST(c_custkey AS VARCHAR) AS symbol FROM customer")
def flatten_nested(t):
    stock = F.struct(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("symbol"))
    pairs = t.customer.groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 2).alias("pair")).agg(F.collect_list(stock).alias("two"))
    catalogue = pairs.groupBy("c_mktsegment", (F.col("pair") % 50).alias("block")).agg(F.create_map(F.first("c_mktsegment"), F.collect_list("two")).alias("catalogue"))
    return finance.flatten_catalogue(catalogue, "catalogue")


@query("SELECT conv_id, CAST(ceil(count(*) / 2.0) AS BIGINT) AS n_chunks, CAST(count(*) % 2 AS BIGINT) AS n_pads FROM conversations GROUP BY 1")
def chunk_array(t):
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    chunks = finance.chunk_list(F.col("turns"), 2, F.lit(-1).cast("long"))
    return turns.select("conv_id", chunks.alias("c")).select("conv_id", F.size("c").cast("long").alias("n_chunks"), F.size(F.filter(F.flatten("c"), lambda x: x == -1)).cast("long").alias("n_pads"))


# --- functions ----------------------------------------------------------------


@query(
    "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS a, round(l_quantity - l_tax, 6) AS b, round(l_quantity * l_tax, 6) AS c, round(l_tax / nullif(l_discount, 0), 6) AS d, CAST(floor(l_quantity / 3) AS BIGINT) AS fl, round(l_quantity - 3 * floor(l_quantity / 3), 6) AS m, round(-l_quantity - (-3) * floor(-l_quantity / -3), 6) + 0.0 AS mn, "
    "round(power(l_quantity, 2), 4) AS p, round(sqrt(l_quantity), 6) AS s, round(exp(l_tax), 6) AS e, round(sin(l_quantity), 6) AS si, round(cos(l_quantity), 6) AS co, round(ln(l_quantity), 6) AS l, abs(l_discount - l_tax) < 0.001 AS near, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) + 0.0 AS half FROM lineitem"
)
def fn_math(t):
    q, x, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    r = lambda c, k=6: F.round(c, k)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", r(q + x).alias("a"), r(q - x).alias("b"), r(q * x).alias("c"), r(F.try_divide(x, d)).alias("d"), scalar.floor_divide(q, F.lit(3)).alias("fl"), r(scalar.modulo(q, F.lit(3))).alias("m"), (r(scalar.modulo(-q, F.lit(-3))) + 0.0).alias("mn"),
        r(F.pow(q, F.lit(2)), 4).alias("p"), r(F.sqrt(q)).alias("s"), r(F.exp(x)).alias("e"), r(F.sin(q)).alias("si"), r(F.cos(q)).alias("co"), r(F.ln(q)).alias("l"), (F.abs(d - x) < 0.001).alias("near"), (scalar.half_even(q / 2) + 0.0).alias("half"),
    )


@query(
    "SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS lo, upper(p_name[1]) || lower(p_name[2:]) AS cap, length(p_name) AS n, p_name[3] AS third, p_brand || '/' || p_type AS joined, repeat(p_brand, 2) AS twice, rpad(p_brand, 12, ' ') || '|' AS padded, string_split(p_name, ' ')[1] AS word, rtrim('  ' || p_name || '  ') AS stripped, starts_with(p_name, 'a') AS starts, replace(p_name, 'a', 'o') AS swapped FROM part"
)
def fn_string(t):
    n, b = F.col("p_name"), F.col("p_brand")
    return t.part.select(
        "p_partkey", F.upper(n).alias("up"), F.lower(n).alias("lo"), scalar.capitalize(n).alias("cap"), F.length(n).cast("long").alias("n"), F.substring(n, 3, 1).alias("third"), F.concat(b, F.lit("/"), F.col("p_type")).alias("joined"), F.repeat(b, F.lit(2)).alias("twice"),
        F.concat(F.rpad(b, 12, " "), F.lit("|")).alias("padded"), F.get(F.split(n, " "), F.lit(0)).alias("word"), F.rtrim(F.concat(F.lit("  "), n, F.lit("  "))).alias("stripped"), n.startswith("a").alias("starts"), F.replace(n, F.lit("a"), F.lit("o")).alias("swapped"),
    )


@query(
    "WITH a AS (SELECT vec_id, [CAST(round(x * 10) AS INTEGER) for x in embedding] AS a FROM embeddings) SELECT vec_id, a[1] AS first, a[-1] AS last, CAST(list_sum(a[2:4]) AS INTEGER) AS mid, CAST(list_sum(a[1:64:2]) AS INTEGER) AS step, list_reverse(a)[1] AS rev, CAST(list_sum(list_append(a, 5)) AS INTEGER) AS appended, CAST(list_sum(list_concat(a, a)) AS INTEGER) AS doubled, len(list_filter(a, lambda x: x = 0)) AS zeros, coalesce(list_position(a, 1) - 1, -1) AS place, list_min(a) AS low, list_max(a) AS high, len(list_distinct(a)) AS kinds, list_contains(a, 2) AS has_two, CAST(list_sum([x * x for x in a]) AS INTEGER) AS squares, len(list_filter(a, lambda x: x > 0)) AS positive, array_to_string(a, ',') AS text FROM a"
)
def fn_array(t):
    # The product is a float's as in the SQL: in doubles 0.15 * 10 lies above or below the tie that floats meet.
    a = F.transform("embedding", lambda x: F.round(x * F.lit(10).cast("float")).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    rows = t.embeddings.select("vec_id", a.alias("a"))
    a = F.col("a")
    return rows.select(
        "vec_id", scalar.item(a, 0).alias("first"), scalar.item(a, -1).alias("last"), total(scalar.array_slice(a, 1, 4)).alias("mid"), total(scalar.array_slice(a, None, None, 2)).alias("step"), F.get(F.reverse(a), F.lit(0)).alias("rev"), total(F.array_append(a, 5)).alias("appended"), total(F.concat(a, a)).alias("doubled"),
        scalar.count_of(a, 0).alias("zeros"), scalar.index_of(a, 1).alias("place"), F.array_min(a).alias("low"), F.array_max(a).alias("high"), F.size(F.array_distinct(a)).alias("kinds"), F.array_contains(a, 2).alias("has_two"), total(F.transform(a, lambda x: x * x)).alias("squares"), F.size(F.filter(a, lambda x: x > 0)).alias("positive"), F.array_join(a, ",").alias("text"),
    )


@query(
    "WITH m AS (SELECT o_orderkey, map {'status': o_orderstatus, 'priority': o_orderpriority} AS m FROM orders) SELECT o_orderkey, array_to_string(map_keys(m), ',') AS keys, array_to_string(map_values(m), ',') AS vals, m['status'] AS status, coalesce(m['none'], 'missing') AS missing, cardinality(m) AS n, map_keys(m)[2] AS second FROM m"
)
def fn_map(t):
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    rows = t.orders.select("o_orderkey", m.alias("m"))
    m = F.col("m")
    return rows.select("o_orderkey", F.array_join(F.map_keys(m), ",").alias("keys"), F.array_join(F.map_values(m), ",").alias("vals"), scalar.map_get(m, "status").alias("status"), scalar.map_get(m, "none", "missing").alias("missing"), F.size(m).alias("n"), scalar.nth_key(m, F.lit(2)).alias("second"))


@query(
    "WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS a, list_reverse([CAST(x AS DOUBLE) for x in embedding]) AS b FROM embeddings) SELECT vec_id, round(list_dot_product(a, b), 6) + 0.0 AS dot, round(list_sum(a) + list_sum(b), 6) + 0.0 AS added, round(a[1] - b[1], 6) + 0.0 AS subtracted, round(a[1] * b[1], 6) + 0.0 AS multiplied FROM v"
)
def fn_vector(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"), F.reverse(F.col("embedding").cast("array<double>")).alias("b"))
    a, b = F.col("a"), F.col("b")
    first = lambda x: F.round(F.get(x, F.lit(0)), 6) + 0.0
    total = F.aggregate(scalar.add(a, b), F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", (F.round(scalar.dot(a, b), 6) + 0.0).alias("dot"), (F.round(total, 6) + 0.0).alias("added"), first(scalar.subtract(a, b)).alias("subtracted"), first(scalar.multiply(a, b)).alias("multiplied"))


@query("SELECT a.l_orderkey % 50 AS i, b.l_suppkey % 20 AS j, CAST(round(sum(a.l_quantity * b.l_quantity), 0) AS BIGINT) AS v FROM (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber = 1) a JOIN (SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber = 2) b USING (l_partkey) GROUP BY 1, 2")
def matmul(t):
    a = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    b = t.lineitem.filter("l_linenumber = 2").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    group = lambda df, i, j: df.groupBy(i.alias("i"), j.alias("j")).agg(F.sum("v").alias("v"))
    left, right = group(a, F.col("i") % 50, F.col("j")), group(b, F.col("i"), F.col("j") % 20)
    return scalar.matmul(left, right).withColumn("v", F.round("v", 0).cast("long"))


@query("SELECT o_orderkey, TRY_CAST(try_strptime(CASE WHEN o_orderkey % 8 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d-%m-%Y') END, '%d-%m-%Y') AS DATE) AS d FROM orders")
def parse_date(t):
    day = F.when(F.col("o_orderkey") % 8 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return t.orders.select("o_orderkey", scalar.parse_day(day).alias("d"))
