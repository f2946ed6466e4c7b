"""Structured Streaming twins: ingest, trailing-minute alerts, and user state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from wayfare.functions.codes import month_key
from wayfare.operators.mapping import known
from wayfare.sources.readers import NAMED, parse_offers


def ingest(spark: SparkSession, source: str, hotels: DataFrame, store: str, checkpoint: str, files: int = 100, rejects: str | None = None) -> StreamingQuery:
    """New CSV files in a folder, appended to the store by month: one micro-batch for each ``files``, exactly once by batch number.

    With ``rejects``, rows that do not parse and the counts of each batch are written below that folder likewise.
    """
    raw = spark.readStream.schema(", ".join(f"{n} string" for n in NAMED)).option("header", True).option("maxFilesPerTrigger", files).csv(source)

    def append(d: DataFrame, batch: int) -> None:
        loaded = parse_offers(d)
        if rejects:
            for name, rows in (("rows", loaded.rejects), ("counts", loaded.stats)):
                rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{rejects}/{name}")
        good = known(loaded.valid, hotels).withColumns({"month_key": month_key("outbound_departure"), "batch": F.lit(batch)})
        # a batch that is run again replaces its own partitions
        good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "month_key").parquet(store)

    return raw.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slow_requests(requests: DataFrame, late: str = "2 minutes", slow_ms: float = 1000.0, least: int = 5) -> DataFrame:
    """(endpoint, start, end, slow_count): sliding minutes with ``least`` or more slow requests; ``requests(ts timestamp, endpoint, duration_ms)``."""
    d = requests.where(F.col("duration_ms") > slow_ms).withWatermark("ts", late).groupBy("endpoint", F.window("ts", "1 minute", "10 seconds").alias("w")).agg(F.count("*").alias("slow_count"))
    return d.where(F.col("slow_count") >= least).select("endpoint", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "slow_count")


def shortlist_state(log: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keeps the log of shortlist actions by key of user: reads give the latest state by ``userstate.shortlist_items``."""

    def append(d: DataFrame, batch: int) -> None:
        d.withColumns({"batch": F.lit(batch), "slice": F.pmod(F.xxhash64("user_id"), F.lit(16))}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "slice").parquet(store)

    return log.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows and batches of the streams of a session, for ``spark.streams.addListener``; ``on_batch`` is told each."""

    def __init__(self, on_batch=None) -> None:
        self.rows = self.batches = self.ended = 0
        self.on_batch = on_batch

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        if self.on_batch:
            self.on_batch({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
