"""Files that arrive are cleaned and appended once, whatever restarts in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def append_new(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, source_format: str = "json") -> StreamingQuery:
    """Read files of ``source`` that no earlier run has seen, transform them row by row, append them to ``sink`` and stop."""
    rows = spark.readStream.schema(schema).format(source_format).load(source)
    query = transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_new_keys(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, key: str, source_format: str = "json") -> StreamingQuery:
    """As ``append_new``, and only rows whose key the sink doesn't have, one for each key and batch.

    A batch that is written again after a failure finds its own rows in the sink and adds none twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        from tessera.sources.io import exists

        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if exists(spark, sink):
            fresh = fresh.join(spark.read.schema(schema).parquet(sink).select(key), key, "left_anti").select(*batch.columns)
        fresh.write.mode("append").parquet(sink)

    rows = spark.readStream.schema(schema).format(source_format).load(source)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_keys_once(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, key: str, time: str, keep: str = "30 days", source_format: str = "json") -> StreamingQuery:
    """As ``append_new``, and of each key only the first row, without reading the sink.

    The keys are state in the checkpoint folder, dealt by key, and expire once the watermark (the latest ``time`` seen
    less ``keep``) has passed a key's time plus ``keep``; a key that comes again later than that is appended again. A
    batch that is replayed after a failure replaces its own files, as the file sink commits by batch. Rows with a null
    key or time are left out.
    """
    rows = spark.readStream.schema(schema).format(source_format).load(source)
    known = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, keep).dropDuplicatesWithinWatermark([key])
    query = known.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def yearly_counts(events: DataFrame, time: str, category: str, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by event-time window and category of a stream, late rows up to ``delay``; works on batches too."""
    marked = events.withWatermark(time, delay) if events.isStreaming else events
    return marked.groupBy(F.window(time, window).alias("w"), category).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), category, "n")
