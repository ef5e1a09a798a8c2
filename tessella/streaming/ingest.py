"""Structured Streaming forms of ingest: not in the batch catalogue, our own addition.

Records are deduplicated by id within the watermark, windowed counts close when the watermark passes them, and a
sink per micro-batch upserts by anti-join, so a restarted stream writes nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8, at: str = "ts") -> DataFrame:
    """Parquet files as a stream; the event time as a timestamp with zone, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def deduplicated(stream: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each id once; late copies are recognised for as long as the watermark allows."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, by: list[str], at: str = "ts", width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """window start, by..., events and total value per tumbling or sliding window."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "events", "total")


def sessions(stream: DataFrame, by: str = "user_id", at: str = "ts", gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, end and events of every session of a user."""
    w = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def write_once(stream: DataFrame, out: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Append the rows whose key the output does not hold yet, one micro-batch after the other."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            fresh = fresh.join(spark.read.parquet(out).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
