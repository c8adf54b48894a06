"""Folding a stream of edge changes into edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import accumulate, merge


class EdgeFold:
    """Edges so far, as a table in ``folder`` named by the last batch in it,
    which each batch replaces. The fold is a sum and two maxima, so late
    changes need no watermark; a batch that is delivered twice counts once.

    A new fold on a folder in use goes on from the last table that was written
    whole. So after a restart with the same checkpoint nothing is lost: batches
    that the stream had committed are in the table, and one that it delivers
    again is known by its number. ``folder`` belongs to one stream's checkpoint."""

    def __init__(self, spark: SparkSession, folder: str, nodes: DataFrame | None = None):
        self.spark, self.folder, self.nodes = spark, folder, nodes
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.last = -1
        if self._files.exists(self._path(folder)):
            for status in self._files.listStatus(self._path(folder)):
                name = status.getPath().getName()
                if name.startswith("batch-") and self._files.exists(self._path(f"{self._at(int(name[6:]))}/_SUCCESS")):
                    self.last = max(self.last, int(name[6:]))

    def _at(self, number: int) -> str:
        return f"{self.folder}/batch-{number}"

    @property
    def edges(self) -> DataFrame | None:
        return None if self.last < 0 else self.spark.read.parquet(self._at(self.last))

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        more = accumulate(batch, self.nodes)
        (more if self.last < 0 else merge(self.edges, more)).write.mode("overwrite").parquet(self._at(number))
        before, self.last = self.last, number
        if before >= 0:
            self._files.delete(self._path(self._at(before)), True)


def fold_stream(log: DataFrame, fold: EdgeFold, checkpoint: str) -> StreamingQuery:
    """Start folding the streaming ``log`` (from, to, delta, ts, type); what is
    there now is folded, then the query ends."""
    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
