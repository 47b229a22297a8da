"""Growing logs as streams: exactly-once rows by key, latest-wins upserts, windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairing import last_by


def tail(spark: SparkSession, folder: str, schema: str, kind: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder; the checkpoint of the query remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def append_once(stream: DataFrame, key: str, time: str, late: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key was not seen within the watermark; files and state commit together."""
    rows = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_latest(stream: DataFrame, keys: list[str], order: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key as a table that is written anew under a name of its batch; a batch that is run again
    writes the same table, so that a failure between the write and the commit changes nothing. current() reads it."""
    spark = stream.sparkSession
    schema = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        path = lambda k: f"{out}/batch={k}"
        old = spark.read.schema(schema).parquet(path(number - 1)) if number else spark.createDataFrame([], schema)
        last_by(old.unionByName(batch), keys, *[F.col(o) for o in order]).select(*schema.names).write.mode("overwrite").parquet(path(number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, query: StreamingQuery, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/batch={query.lastProgress['batchId']}")


def windowed_counts(stream: DataFrame, time: str, by: list[str], late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows of event time; rows later than the watermark are dropped by Spark."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def sessions(stream: DataFrame, time: str, by: list[str], late: str, gap: str) -> DataFrame:
    """Counts in sessions that end after a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
