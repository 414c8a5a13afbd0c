"""Streams: documents seen before are dropped by content hash, visits are counted in windows.

A stream keeps its checkpoint and its sink in the folder that the cluster names in spark.checkpoint.dir, so
that a restarted driver goes on where the last one ended.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import _HASH_SQL, content_hash
from ..session import let_workers_import, shared_folder, table


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def first_contents(docs: DataFrame) -> DataFrame:
    """Content hashes that the stream has not shown before; the state has no expiry and grows with distinct contents."""
    return docs.select(content_hash().alias("content_hash")).dropDuplicates(["content_hash"])


def first_visits(visits: DataFrame, keys: list[str], ts: str, ttl: timedelta, late: timedelta = timedelta(0)) -> DataFrame:
    """Visits of keys that were not seen within the time to live before them, which each visit renews.

    Returns the keys, ts, first_seen (the key's first visit of all that its state has seen) and visits (how many the state
    had seen before). A key's state is its first and last visit and their number; it goes once the watermark, `late`
    behind the newest visit, is past its last visit by the time to live. Visits without a time are left out; a visit
    that comes late within the watermark counts as a repeat if it is older than the key's last one.
    """
    life = int(ttl.total_seconds() * 1e6)
    schema = visits.select(*keys).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        first, last, seen = state.get if state.exists else (None, None, 0)
        stamps = np.sort(np.concatenate([b["stamp"].to_numpy(np.int64) for b in batches]))
        if not len(stamps):
            return
        before = np.maximum.accumulate(np.r_[stamps[0] - life - 1 if last is None else last, stamps[:-1]])
        new = np.flatnonzero(stamps - before > life)
        first = int(stamps[0]) if first is None else first
        last = int(max(stamps[-1], before[-1]))
        state.update((first, last, seen + len(stamps)))
        state.setTimeoutTimestamp(max((last + life) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**dict(zip(keys, ([k] * len(new) for k in key), strict=True)), "stamp": stamps[new], "first": [first] * len(new), "visits": seen + new})

    rows = visits.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, f"{int(late.total_seconds() * 1000)} milliseconds")
    rows = rows.select(*keys, ts, F.unix_micros(ts).alias("stamp"))
    found = rows.groupBy(*keys).applyInPandasWithState(run, f"{fields}, stamp long, first long, visits long", "first long, last long, seen long", "append", "EventTimeTimeout")
    return found.select(*keys, F.timestamp_micros("stamp").alias(ts), F.timestamp_micros("first").alias("first_seen"), "visits")


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and type; with a watermark, closed windows leave the state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived and read its sink; complete results replace what a batch before wrote."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{at}/rows")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows"))
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def t02_stream_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(first_contents(table_stream(spark, sf_dir, "documents")), "t02")


def t01_stream_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a user and type of event that the stream had not seen in the two days before, with how many it had seen."""
    let_workers_import(spark)
    found = first_visits(table_stream(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", timedelta(days=2))
    return run_to_table(found, "t01").select("user_id", "event_type", F.unix_micros("ts").alias("ts"), F.unix_micros("first_seen").alias("first_seen"), "visits")


def t06_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = run_to_table(windowed_counts(table_stream(spark, sf_dir, "events")), "t06", "complete")
    return counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {q.__name__: q for q in (t01_stream_visits, t02_stream_contents, t06_stream_windows)}
ORACLES = {
    "t01_stream_visits": """WITH v AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
      o AS (SELECT *, lag(t) OVER w AS before, first_value(t) OVER w AS first_seen, row_number() OVER w - 1 AS visits FROM v WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t))
      SELECT user_id, event_type, t AS ts, first_seen, visits FROM o WHERE before IS NULL OR t - before > 172800000000""",
    "t02_stream_contents": f"SELECT DISTINCT {_HASH_SQL} AS content_hash FROM documents",
    "t06_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
