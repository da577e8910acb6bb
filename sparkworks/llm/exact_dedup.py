"""Exact deduplication with DataFrame functions only (operator 4).

Texts are equal when they are identical after lower-casing A-Z.  Equal rows
are combined in three steps, and each step groups by the whole text beside its
digest, so two texts with the same digest are never taken for one:

1. every input partition keeps one row per text (Spark's map-side aggregate);
2. those rows meet by (salt, digest, text), the salt being the number of the
   input partition, so that no task receives all copies of a frequent text;
3. the winners of the salts, at most ``salts`` per text, meet by (digest, text).

Afterwards only digests travel: rows and groups are joined on the digest, a
short key, and adaptive execution splits a digest that holds many rows.  Should
one digest ever have two texts, which step 3 counts, rows with such digests
are joined on their text as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkworks.llm.common import lower_ascii, settle


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """One row per distinct normalised text: digest, text, keep_id (largest id), group_size.

    A null text counts as empty; null ids lose to all others, and ``keep_id``
    is null only where all ids of a group are.
    """
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", (F.spark_partition_id() % salts).alias("salt"))
    local = rows.groupBy("salt", digest(F.col("text")).alias("digest"), "text").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return local.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  ``kept`` says whether a
    row has the id that stays; rows that repeat both id and text are all
    marked kept, and a group without any id keeps all its rows.  An empty
    table gives an empty result.  Other columns are ignored, whatever their
    names; ``digest`` is a function of a Column, for tests of collisions.
    """
    groups = exact_groups(df, id_col, text_col, salts, digest)
    short = settle(groups.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    out = rows.drop("text").join(short.filter("texts = 1").drop("texts"), "digest")
    if not short.filter("texts > 1").isEmpty():
        shared = short.filter("texts > 1").select("digest")
        out = out.unionByName(rows.join(shared, "digest", "left_semi").join(groups, ["digest", "text"]).drop("text"))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one per distinct text.

    Of rows that repeat both id and text, or of equal texts without any id,
    one stays.
    """
    kept = settle(exact_dedup(df, id_col, text_col, salts).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies")))
    key = sha256(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))))
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), key.alias("digest"))
    same = row["id"].eqNullSafe(kept["doc_id"]) & (row["digest"] == kept["text_sha256"])
    out = row.join(kept, same, "left_semi")
    if not kept.filter("copies > 1").isEmpty():
        out = out.dropDuplicates(["id", "digest"])
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
