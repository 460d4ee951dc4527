"""A sync as a stream: each micro-batch of saved tracks is a chunk, its offset in the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ledgerline.operators.matching import prepare_target
from ledgerline.operators.sync import chunk_reports, run_sync

_COUNTERS = "tracks_matched bigint, tracks_not_matched bigint, tracks_skipped bigint, already_in_target bigint, code_matches bigint, fuzzy_matches bigint"
#: Seconds between two looks at whether a run has been cancelled.
POLL = 2.0


class Progress(StreamingQueryListener):
    """Tells a callback after every micro-batch: its number, its rows and rows a second."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"id": str(p.id), "batch_id": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class ChunkedSync:
    """Sinks of a streamed sync under one folder: favorites by batch, errors, and a report for each chunk.

    A micro-batch holds as many files as the stream takes at once, and is decided on as a whole; its
    tracks belong to chunks by their position. A batch that runs again after a failure writes the same
    folder again. What earlier batches wrote is read anew in every batch, so a track that one of them, or
    an earlier run (ledger_ids), wrote is skipped and a target is never written twice. The catalog is
    prepared once. What a sink fails on is an error and isn't written.
    """

    def __init__(self, spark: SparkSession, folder: str, target: DataFrame, favorites: DataFrame, ledger_ids: DataFrame | None = None, sink: Callable[[list], None] | None = None):
        self.spark, self.folder, self.favorites, self.sink = spark, folder.rstrip("/"), favorites, sink
        self.target = prepare_target(target)
        self.ledger_ids = spark.createDataFrame([], "source_id string") if ledger_ids is None else ledger_ids.select("source_id")

    def _read(self, name: str, schema: str) -> DataFrame:
        return stored(self.spark, self.folder, name, schema)

    def written(self) -> DataFrame:
        return self._read("writes", "target_id bigint, source_id string, position bigint, chunk bigint, batch bigint, batch_id bigint")

    def reports(self) -> DataFrame:
        """The counters of each chunk in each micro-batch."""
        return self._read("reports", f"chunk bigint, {_COUNTERS}, batch_id bigint")

    def errors(self) -> DataFrame:
        return self._read("errors", "chunk bigint, batch bigint, error string, batch_id bigint")

    def totals(self) -> DataFrame:
        """One row: the counters so far, whichever runs they come from."""
        return self.reports().agg(*(F.coalesce(F.sum(c.split()[0]), F.lit(0)).alias(c.split()[0]) for c in _COUNTERS.split(", ")))

    def take(self, batch: DataFrame, batch_id: int) -> None:
        earlier = self.written().where(F.col("batch_id") != batch_id)
        there = self.favorites.unionByName(earlier.select(F.lit(None).cast("bigint").alias("position"), F.col("target_id").alias("id"), F.concat(F.lit("written-"), "target_id").alias("code")))
        done = run_sync(batch, self.target, self.ledger_ids.union(earlier.select("source_id")), there, sink=self.sink)
        counters = [c.split()[0] for c in _COUNTERS.split(", ")]
        for name, rows in (("writes", done.writes), ("errors", done.errors), ("reports", chunk_reports(done.classified).select("chunk", *counters))):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch_id={batch_id}")

    def run(self, tracks: DataFrame, checkpoint: str, cancelled: Callable[[], bool] | None = None, tell: Callable[[dict], None] | None = None) -> bool:
        """Takes all that is there now, in micro-batches, and goes on where the checkpoint ends.

        Whether it got to the end: a run that cancelled says has been cancelled is stopped, and the batch
        under way is taken again by the next run. tell gets the progress of each micro-batch.
        """
        listener = Progress(tell) if tell else None
        if listener:
            self.spark.streams.addListener(listener)
        try:
            query = tracks.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            while not query.awaitTermination(POLL):
                if cancelled is not None and cancelled():
                    query.stop()
                    return False
            return True
        finally:
            if listener:
                self.spark.streams.removeListener(listener)


def stored(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """What a ChunkedSync has put under its folder; nothing yet is an empty table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    return spark.createDataFrame([], schema)


def expire_stream(events: DataFrame, key: str, ts: str, gap: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): spells of activity of a stream, each ended by a gap; the watermark closes them."""
    windowed = events.withWatermark(ts, gap).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
