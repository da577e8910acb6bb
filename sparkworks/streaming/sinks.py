"""Streams that are written to two places (R2, R3, S13, S14): good rows to one, rejects to the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class SplitSink:
    """Writes each batch of a stream to ``<folder>/accepted/batch=N`` and ``<folder>/rejected/batch=N``.

    A batch replaces what lies under its own number.  So a batch that was
    written in part, or whole but not recorded in the checkpoint, is written
    again by the restarted stream and neither loses nor repeats a row: Spark
    gives a batch of one number the same rows again.  Other sinks that name
    what they write by the batch's number (a table's partition, a message key)
    work the same way through ``write``.
    """

    def __init__(self, folder: str, good: Column, write: Callable[[DataFrame, str, int], None] | None = None):
        self.folder, self.good = folder.rstrip("/"), good
        self.write = write or self._replace

    def _replace(self, rows: DataFrame, side: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{side}/batch={batch}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.persist()  # read for either side
        try:
            good = F.coalesce(self.good, F.lit(False))
            self.write(rows.filter(good), "accepted", batch)
            self.write(rows.filter(~good), "rejected", batch)
        finally:
            rows.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True, **options: str) -> StreamingQuery:
        """Run the stream: over all there is with ``once``, else on and on."""
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).options(**options)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def read(self, spark: SparkSession, side: str) -> DataFrame:
        """Rows of one side with the number of their ``batch``."""
        return spark.read.parquet(f"{self.folder}/{side}")
