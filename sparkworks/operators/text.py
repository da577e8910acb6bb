"""Text features and vector retrieval (T, M10)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkworks.operators.neighbours import build_index, knn_join, similarity_search  # noqa: F401
from sparkworks.operators.ranges import settle

# English words that carry no topic.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be been before being below between both but by can could did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor "
    "not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case tokens of two or more word characters, without stop words; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w\w+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(list(stop_words))) if stop_words else found


def tokenize(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """One row per token of each document: key, term."""
    return df.select(key, F.explode(tokens(F.col(text), stop_words)).alias("term"))


def term_counts(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    return tokenize(df, key, text, stop_words).groupBy(key, "term").agg(F.count("*").alias("tf"))


@dataclass
class TfidfModel:
    """What was learned of a corpus: a row (term, idf) for each of at most ``max_features`` terms."""

    terms: DataFrame
    stop_words: Sequence[str] = tuple(STOP_WORDS)

    def transform(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, term, weight) of other texts too: tf * idf, each document scaled to length 1; terms not learned are left out."""
        return self._weights(term_counts(df, key, text, self.stop_words), key)

    def _weights(self, counts: DataFrame, key: str) -> DataFrame:
        # The terms are as many as were asked for when the model was fitted.
        raw = counts.join(F.broadcast(self.terms), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
        return raw.select(key, "term", (F.col("w") / length).alias("weight"))

    def save(self, path: str) -> str:
        self.terms.coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
        self.terms.sparkSession.createDataFrame([(w,) for w in self.stop_words], "word string").coalesce(1).write.mode("overwrite").parquet(f"{path}/stop_words")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TfidfModel":
        return TfidfModel(spark.read.parquet(f"{path}/terms"), tuple(r[0] for r in spark.read.parquet(f"{path}/stop_words").collect()))


def _learned(counts: DataFrame, n: DataFrame, max_features: int) -> DataFrame:
    """(term, idf) of the most frequent terms, equal ones in order of the term: ln((1 + n) / (1 + df)) + 1."""
    terms = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    top = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return top.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_fit(df: DataFrame, key: str, text: str, max_features: int = 10_000, stop_words: Sequence[str] = STOP_WORDS) -> TfidfModel:
    """Learn the ``max_features`` most frequent terms and their idf from training texts."""
    counts = term_counts(df, key, text, stop_words)
    return TfidfModel(settle(_learned(counts, df.agg(F.count("*").alias("n")), max_features)), stop_words)


def tfidf(df: DataFrame, key: str, text: str, max_features: int = 10_000, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Fit and transform the same texts: (key, term, weight).

    Texts are dealt by key and taken apart there, once; a key's counts are
    settled as one row, and such rows are dealt again, so no counts are shuffled one by one.
    """
    dealt = df.select(key, text).repartition(F.col(key))
    cells = term_counts(dealt, key, text, stop_words).groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("c"))
    # Terms hold no blanks; joined, with whole numbers beside them, they take a quarter of the room of rows.
    held = settle(cells.select(key, F.array_join("c.term", " ").alias("terms"), F.col("c.tf").cast("array<int>").alias("tfs")))
    apart = lambda rows: rows.select(key, F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf"))).alias("c")).select(key, "c.*")
    learned = settle(_learned(apart(held), df.agg(F.count("*").alias("n")), max_features))
    return TfidfModel(learned, stop_words)._weights(apart(held.repartition(F.col(key))), key)


def top_keywords(weights: DataFrame, key: str, n: int = 2) -> DataFrame:
    """The n terms of the largest weight of each document, joined by a blank; equal weights in order of the term."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    top = weights.filter("weight > 0").withColumn("_rank", rank).filter(F.col("_rank") <= n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "term"))), lambda x: x["term"])
    return top.groupBy(key).agg(F.array_join(ordered, " ").alias("keywords"))


def vocabulary(weights: DataFrame) -> DataFrame:
    return weights.select("term").distinct().orderBy("term")


class SmoothIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts times ln((1 + n) / (1 + df)) + 1, fitted on the training rows; Spark's own weights lack the 1."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        weights = IDF(inputCol=self.getInputCol(), outputCol="_idf").fit(dataset).idf.toArray() + 1
        return ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def sentiment_pipeline(text: str, label: str, max_features: int = 10_000, n_rows: int | None = None) -> Pipeline:
    """Tokens, counts, idf weights, unit length and logistic regression; ``n_rows`` sets the usual strength of the penalty."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\w\w+", gaps=False),
            StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=list(STOP_WORDS)),
            CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=max_features),
            SmoothIdf(inputCol="_counts", outputCol="_weights"),
            Normalizer(inputCol="_weights", outputCol="features", p=2.0),
            LogisticRegression(labelCol=label, regParam=1.0 / n_rows if n_rows else 0.0, standardization=False),
        ]
    )


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does, with up to ``overlap`` characters carried over."""

    def parts(piece: str, level: int) -> Iterator[str]:
        if len(piece) <= size or level >= len(separators):
            yield piece
        elif separators[level] == "":
            step = size - overlap if size > overlap else size
            yield from (piece[k : k + size] for k in range(0, len(piece), step))
        else:
            cut = piece.split(separators[level])
            for k, x in enumerate(cut):
                yield from parts(x + (separators[level] if k + 1 < len(cut) else ""), level + 1)

    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts(text, 0):
        if held and length + len(part) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if held:
        out.append("".join(held))
    return [x.strip() for x in out if x.strip()]


@F.udtf(returnType="chunk_no int, chunk string", useArrow=True)
class SplitText:
    """A table function, its rows moved by Arrow: the pieces of ``split_text`` of each text, numbered from 0; a null or blank text has none."""

    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_text(text or "", size, overlap))


def chunk_text(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, chunk_no (from 0) and chunk of every document: a lateral join with ``SplitText``."""
    if size < 1 or overlap < 0:
        raise ValueError("chunks have a character at least and carry none or some over")
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.lateralJoin(SplitText(F.col("_text").outer(), F.lit(size), F.lit(overlap))).select(F.col("_key").alias(key), "chunk_no", "chunk")


def chunk_fixed(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks at a fixed stride of size - overlap characters."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    rows = df.filter(F.length(text) > 0).select(key, text, F.posexplode(starts).alias("chunk_no", "_at"))
    return rows.select(key, "chunk_no", F.substring(F.col(text), F.col("_at") + 1, F.lit(size)).alias("chunk"))


def concat_pages(df: DataFrame, key: str, position: str, text: str, separator: str = "\n") -> DataFrame:
    """Texts of a key joined in order of position."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text])
    return df.groupBy(key).agg(F.array_join(ordered, separator).alias("text"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def l2_normalize(df: DataFrame, vector: str) -> DataFrame:
    """Vectors of length 1; a zero vector stays."""
    return df.withColumn("_norm", norm(F.col(vector))).withColumn(vector, F.when(F.col("_norm") > 0, F.transform(vector, lambda x: x / F.col("_norm"))).otherwise(F.col(vector).cast("array<double>"))).drop("_norm")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def bullet_join(column: Column, prefix: str = "- ") -> Column:
    """Items of an array, each after a prefix, one per line."""
    return F.array_join(F.transform(column, lambda x: F.concat(F.lit(prefix), x)), "\n")
