"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import math
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder, and any other
    raises: its executors would write to disks of their own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that the session names and read it from there.

    The copy survives lost executors and cuts the lineage.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(df.sparkSession)
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    return df.checkpoint()


def settle_unsized(df: DataFrame) -> DataFrame:
    """``settle`` for rounds: the copy has no estimate of its size.

    A checkpoint keeps the estimate of the plan that made it, and that of a
    join is the product of its sides.  Where each round joins what the one
    before it settled with itself, the digits double with every join, to
    megabytes after some twenty, which the driver holds and multiplies.
    """
    held = settle(df)._jdf
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), session)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, which gives back unused memory when a task ends.

    Spark keeps a worker for later tasks, and what its allocators hold then
    would add up over the kinds of tasks that it has run.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library than GNU's
            pass

    return whole


def squeezed(df: DataFrame) -> DataFrame:
    """``df`` with its column ``text``, which holds no null, compressed for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            texts = pa.array([engine.compress(x.as_py().encode()) for x in batch["text"]], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in df.schema]))


def unsqueeze(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of compressed texts."""
    engine = zstandard.ZstdDecompressor()
    return pa.array([engine.decompress(x.as_py()) for x in column], pa.binary())


def small(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, whose texts are decompressed a slice at a time."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null.

    Where a text is ASCII throughout, the built-in ``lower`` does the same and
    is several times as fast as ``translate``.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def partitions(df: DataFrame, least: int = 8) -> int:
    """How many parts to deal a shuffle of df's session into."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def few(df: DataFrame, rows: int, each: int = 50_000) -> int:
    """How many tasks to coalesce some ``rows`` rows into: two a core, more where a task would get over ``each``.

    Shuffles of a small table have as many parts as those of the largest one.
    Each part is a task, with a file and a record that the driver keeps, in
    every step that reads the table again.
    """
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / each))
