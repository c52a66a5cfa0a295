"""Streams of writes into a keyspace, streaming views of the newest rows and of event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keyspace import Keyspace
from ..schema import PUT


def ingest(stream: DataFrame, keyspace: Keyspace, checkpoint: str, order_by: str = "seq", available_now: bool = True, name: str | None = None):
    """Write each micro-batch of ``key, value, op, <order_by>`` as one batch.

    The log keeps the stream's name (by default its checkpoint) and the number of
    each micro-batch, and so does the manifest of what was flushed. A micro-batch
    that is replayed after a failure is hence not written twice, and later writes
    keep their place.
    """
    name = name or checkpoint

    def put(batch: DataFrame, number: int) -> None:
        keyspace.write_batch(batch, order_by, stream=(name, number))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windows(stream: DataFrame, width: str, slide: str | None = None, late: str = "0 seconds", ts: str = "ts", by: str = "key") -> DataFrame:
    """Writes a key and event-time window; rows later than ``late`` behind the newest are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = stream.withWatermark(ts, late).groupBy(window.alias("w"), F.col(by).alias("key")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "key", "n")


def sessions(stream: DataFrame, gap: str, late: str = "0 seconds", ts: str = "ts", by: str = "key") -> DataFrame:
    """Runs of a key's writes that are less than ``gap`` apart."""
    counts = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(by).alias("key")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "key", "n")


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a streaming query over what is there, into Parquet; the table it left."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = rows.sparkSession
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)


def newest(stream: DataFrame) -> DataFrame:
    """The live rows of a streamed log, as an aggregate for complete or update mode.

    Order is by ``seq``, so late rows do no harm and no watermark is needed; the
    state holds one row a key.
    """
    last = stream.groupBy("key").agg(F.max_by(F.struct("value", "op", "seq"), "seq").alias("last"))
    return last.where(F.col("last.op") == PUT).select("key", F.col("last.value").alias("value"), F.col("last.seq").alias("seq"))
