"""The crawl as Structured Streaming: new URLs, running counters and per-domain delays, over files as they arrive.

Streams run until their input is used up (``availableNow``) and can be started again on the same folder, where they go on from
their checkpoint.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over Parquet files with the schema that they have now."""
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may be a folder or a single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def append(stream: DataFrame, at: str) -> DataFrame:
    """Runs the stream to the end of its input and returns all that it has written to ``at`` so far."""
    stream.writeStream.format("parquet").option("path", f"{at}/data").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/data")


def latest(stream: DataFrame, at: str) -> DataFrame:
    """The same for aggregates that are written whole after each batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/data")

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/data")


def new_urls(urls: DataFrame, key: str = "url", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each URL once. Without an event time the state keeps every URL; with one, only those of the last ``delay``."""
    if event_time is None:
        return urls.dropDuplicates([key])
    return urls.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def counters(events: DataFrame, by: Column, value: Column) -> DataFrame:
    return events.groupBy(by.alias("counter")).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))


def windowed(events: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; windows close once the watermark has passed them."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size).alias("window"), by).agg(F.count("*").alias("n")).select("window.start", "window.end", by, "n")


def admit(fetches: DataFrame, key: str, ts: str, delay: float) -> DataFrame:
    """(key, ts, admitted): a fetch is admitted once ``delay`` seconds have passed since the key's last admitted one.

    The state of a key is the time of that fetch. Within a batch a key's fetches are taken in order of time.
    """
    step = int(delay * 1e6)

    def run(keys, parts, state):
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        last = state.get[0] if state.exists else None
        kept = []
        for t in rows["at"].tolist():
            kept.append(last is None or t - last >= step)
            last = t if kept[-1] else last
        state.update((last,))
        yield pd.DataFrame({"key": [keys[0]] * len(rows), "at": rows["at"].tolist(), "admitted": kept})

    d = fetches.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    out = d.groupBy("key").applyInPandasWithState(run, "key bigint, at bigint, admitted boolean", "last bigint", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_micros(F.col("at")).alias(ts), "admitted")
