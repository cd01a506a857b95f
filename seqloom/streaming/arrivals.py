"""Streams around the index: queries against it, new genomes into it, signals out of events.

Additions beside the batch operators; their results are those of the batch
operators over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_queries(stream: DataFrame, contigs: DataFrame, sink, checkpoint: str, k: int = 31):
    """Each micro-batch of (query_name, seq) gets its candidates; ``sink(frame, batch_id)`` takes them."""
    from seqloom.config import SearchConfig
    from seqloom.operators.search import containment

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(containment(batch, contigs, SearchConfig(kmer_size=k)), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def append_genomes(stream: DataFrame, folder: str, checkpoint: str, k: int = 31):
    """Each micro-batch of contigs becomes a shard."""
    from seqloom.operators.index_store import add_genomes

    return stream.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else add_genomes(batch, folder, k)).option(
        "checkpointLocation", checkpoint
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Reads assembled from (user_id, ts, value): one per user and session, with count, mean and extremes.
    Works on a stream (with a watermark) and on a table alike."""
    kind = events.schema["ts"].dataType.simpleString()
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need the type with time zone
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        rows.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n_values"), F.avg("value").alias("mean_value"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select("user_id", F.col("w.start").cast(kind).alias("started"), F.col("w.end").cast(kind).alias("ended"), "n_values", "mean_value", "low", "high")
    )
