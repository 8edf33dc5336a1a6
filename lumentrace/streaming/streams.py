"""Structured Streaming: extraction results and events as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.functions import json_repair
from lumentrace.operators import filters
from lumentrace.session import setting

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_source(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder in order of their modification."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def json_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return file_source(spark, path, schema, "json", files_per_trigger)


def properties(answers: DataFrame) -> DataFrame:
    """Valid properties of a stream of answers; stateless, so each batch is as in ``parsed_rows``."""
    return json_repair.parsed_rows(answers).where("error_type is null").where(filters.valid_property())


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts by event time; windows close once the watermark passes them."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, ts: str, key: list[str], late: str = "2 hours") -> DataFrame:
    """Events without repeats of a key while the watermark remembers it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", now: bool = True):
    """Write to parquet; ``now`` works off what is there and ends."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if now else writer
    return writer.format("parquet").option("path", path).start()


def first_rows(stream: DataFrame, key: list[str], ts: str | None = None, ttl: str = "1 day") -> DataFrame:
    """Rows whose key no earlier row brought, once for each key, by the state of the keys alone.

    Keys are remembered for ever, or, with a time ``ts``, until the latest time of the stream is ``ttl`` past a key's first
    row and as much again; then they may come again, and rows that are later than ``ttl`` are dropped. Null keys are keys.
    """
    return once(stream, ts, key, ttl) if ts else stream.dropDuplicates(key)


def paired(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of two streams with one key, the right one no earlier than the left one and at most ``within`` later.

    Both times are watermarks, so a row's state goes once no partner can come. The right key goes; other names must differ.
    """
    a, b = left.withWatermark(left_ts, late), right.withWatermark(right_ts, late).withColumnRenamed(key, "right_key")
    in_time = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col("right_key")) & in_time).drop("right_key")


def start_with_state(stream: DataFrame, path: str, checkpoint: str, now: bool = True):
    """As ``start``, with the state of keys in RocksDB on the executors' disks in place of their memory."""
    with setting(stream.sparkSession, PROVIDER, ROCKS):
        return start(stream, path, checkpoint, "append", now)


def merged(stream: DataFrame, path: str, checkpoint: str, key: list[str], now: bool = True, ts: str | None = None, ttl: str = "1 day"):
    """``first_rows`` written to a parquet table: what it holds is never read, and the sink's log keeps a repeated batch out."""
    return start_with_state(first_rows(stream, key, ts, ttl), path, checkpoint, now)
