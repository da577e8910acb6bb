"""The registered queries of this subpackage: one per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkworks.llm.collocations import collocations
from sparkworks.llm.common import remainder, shared_folder, table
from sparkworks.llm.embedding_dedup import embedding_dedup
from sparkworks.llm.exact_dedup import exact_dedup
from sparkworks.llm.language_id import identify, learn_profiles
from sparkworks.llm.near_dedup import near_dedup
from sparkworks.llm.packing import pack_documents
from sparkworks.llm.periodic_runs import periodic_runs, with_repeated_tail
from sparkworks.llm.pitman_yor import score_texts
from sparkworks.llm.quality import learn_quality, score_quality
from sparkworks.llm.sentencepiece import decode, encode
from sparkworks.llm.substring_dedup import remove_repeats
from sparkworks.llm.top_products import top_products
from sparkworks.llm.warc import page_records, read_warc, write_warc


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's vocabulary file lies on this cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 4)
    model = learn_quality(documents, table(spark, sf_dir, "labels"), learn=fold != 2)
    return score_quality(documents, model, held_out=fold == 2)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), learned=remainder(F.col("doc_id"), 10) != 0)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("decoded_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_warc(table(spark, sf_dir, "pages"), shared_folder(spark))
    return page_records(read_warc(spark, out), whole=True)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=75)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, limit=2048)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), threshold=50, anchor=10)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 3)
    return identify(documents, learn_profiles(documents.filter(fold != 1)), held_out=fold == 1)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeated_tail(table(spark, sf_dir, "documents"), share=10), power=4, least=6)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    top = F.col("top")
    shape = (-top["s"]).alias("start"), top["n"].alias("length"), (-top["q"]).alias("period"), F.floor(top["n"] * 1000 / -top["q"]).alias("exponent_milli")
    return out.select("doc_id", "n_runs", *shape, "runs_sha256", "collapsed_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, longest=4, top=2000, cover=80, scale=2_000_000)


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 100 == 0, k=10, scale=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_pitman_yor, op3_sentencepiece, op4_exact_dedup, op5_warc, op6_near_dedup, op7_embedding_dedup, op8_packing, op9_substring_dedup, op10_language_id, op11_periodic_runs, op12_collocations, op13_top_products)}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(e) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
        reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a),
        comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS k FROM link GROUP BY a)
        SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        k AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM k
    """,
    "op11_periodic_runs": """
        WITH h AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) AS h
            FROM documents),
        g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
        d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
        u AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
        same AS (SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
        stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        run AS (SELECT * FROM stretch x WHERE NOT EXISTS (FROM stretch y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.n >= x.s + x.n)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM run),
        kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS c FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        told AS (SELECT doc_id, count(*) AS k, max({'n': n, 's': -s, 'q': -q}) AS top, sha256(string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q)) AS r FROM run GROUP BY doc_id)
        SELECT d.doc_id, coalesce(k, 0) AS n_runs, -top.s AS start, top.n AS length, -top.q AS period, 1000 * top.n // -top.q AS exponent_milli, coalesce(r, sha256('')) AS runs_sha256, coalesce(c, sha256('')) AS collapsed_sha256
        FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op12_collocations": """
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t),
        w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
        s AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 5) r(m) WHERE len(w) >= m),
        c AS (SELECT lang, m, w[i : i + m - 1] AS g, count(*) AS f FROM s GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM c WHERE m = 1 GROUP BY lang),
        a AS (SELECT lang, m, g, f FROM c WHERE m > 1 AND f >= 30),
        k AS (SELECT a.lang, a.m, a.g, a.f AS a, k, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * a.f // (CAST(l.f AS HUGEINT) + r.f) AS score
              FROM a, range(1, 4) q(k), c l, c r WHERE k < a.m AND l.lang = a.lang AND l.g = a.g[1 : k] AND r.lang = a.lang AND r.g = a.g[k + 1 : a.m]),
        b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        x AS (SELECT lang, f, g[i + 1 : i + z] AS g FROM a, range(2, 4) y(z), range(0, 3) v(i) WHERE z < m AND i + z <= m),
        u AS (SELECT lang, g, max(f) AS f FROM x GROUP BY lang, g),
        d AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN u USING (lang, g) WHERE u.f IS NULL OR CAST(100 AS HUGEINT) * u.f < CAST(80 AS HUGEINT) * b.a),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op13_top_products": """
        WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10
    """,
}
