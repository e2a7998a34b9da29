"""Event telemetry, in batch and as streams: cache statistics in windows, live routes with expiry, newest rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.network import EXPIRY_SECONDS

#: What each kind of event tells (fixed values of the adapter).
HITS, MISSES = ("purchase", "click"), ("error",)


def commands(events: DataFrame) -> DataFrame:
    """command, n_bytes, ms of events: purchases and clicks are hits, errors misses, others overhead."""
    kind = F.when(F.col("event_type").isin(*HITS), "CACHEHIT").when(F.col("event_type").isin(*MISSES), "CACHEMISS").otherwise("ComOH")
    return events.select("event_id", "ts", "user_id", kind.alias("command"), F.floor(F.col("value") * 1000).cast("long").alias("n_bytes"), F.get_json_object("props", "$.k").cast("long").alias("ms"))


WIRE = "command string, pid string, size bigint, comm_oh bigint, ts timestamp_ntz"
_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def to_wire(told: DataFrame) -> DataFrame:
    """Telemetry rows as JSON lines (column value), the form of files and queues; a sink is any writer of strings."""
    fields = F.struct("command", F.col("user_id").cast("string").alias("pid"), F.col("n_bytes").alias("size"), F.col("ms").alias("comm_oh"), "ts")
    return told.select(F.to_json(fields, _TIME).alias("value"))


def from_wire(lines: DataFrame) -> DataFrame:
    """Telemetry rows of JSON lines, from a table or a stream; lines that aren't telemetry are left out."""
    return lines.select(F.from_json("value", WIRE, _TIME).alias("t")).where("t.command is not null").select("t.*")


def _stats() -> list[Column]:
    hit, miss = F.col("command") == "CACHEHIT", F.col("command") == "CACHEMISS"
    ms = F.sum(F.when(miss, F.col("ms")).otherwise(0))
    return [
        F.sum(hit.cast("long")).alias("hits"), F.sum(miss.cast("long")).alias("misses"), F.sum(F.when(miss, F.col("n_bytes")).otherwise(0)).alias("miss_bytes"), ms.alias("miss_ms"),
    ]


def _speed(df: DataFrame) -> DataFrame:
    """Bytes a second of misses; 0 without any time spent."""
    return df.withColumn("speed", F.when(F.col("miss_ms") > 0, F.col("miss_bytes") / (F.col("miss_ms") / 1000.0)).otherwise(0.0))


def cache_stats(told: DataFrame, *by: str) -> DataFrame:
    return _speed(told.groupBy(*by).agg(*_stats()))


def cache_stats_windowed(told: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same in time windows; on a stream, rows later than ``late`` are dropped and closed windows go out."""
    told = told.withColumn("ts", F.col("ts").cast("timestamp"))
    if told.isStreaming:
        told = told.withWatermark("ts", late)
    return _speed(told.groupBy(F.window("ts", width).alias("w")).agg(*_stats())).select(F.col("w.start").alias("window_start"), "hits", "misses", "miss_bytes", "miss_ms", "speed")


def live_routes(hops: DataFrame, seconds: int = EXPIRY_SECONDS) -> DataFrame:
    """A stream of hops (dst, via, distance, ts) as a stream of upserts; a route idle for so long in event time is told
    as expired (distance null)."""
    schema = "dst string, via string, distance long, ts timestamp, live boolean"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            distance, ts = state.get
            state.remove()
            yield pd.DataFrame({"dst": [key[0]], "via": [key[1]], "distance": pd.array([None], "Int64"), "ts": [pd.Timestamp(ts, unit="us")], "live": [False]})
            return
        distance, ts = state.get if state.exists else (None, -(1 << 62))
        for pdf in frames:
            at = pdf.ts.astype("datetime64[us]").astype("int64")
            k = at.to_numpy().argmax() if len(pdf) else None
            if k is not None and at.iloc[k] >= ts:
                distance, ts = int(pdf.distance.iloc[k]), int(at.iloc[k])
        state.update((distance, ts))
        state.setTimeoutTimestamp(max(ts // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"dst": [key[0]], "via": [key[1]], "distance": pd.array([distance], "Int64"), "ts": [pd.Timestamp(ts, unit="us")], "live": [True]})

    keyed = hops.select(F.col("dst").cast("string").alias("dst"), F.col("via").cast("string").alias("via"), F.col("distance").cast("long").alias("distance"), F.col("ts").cast("timestamp").alias("ts"))
    grouped = keyed.withWatermark("ts", "0 seconds").groupBy("dst", "via")
    return grouped.applyInPandasWithState(run, schema, "distance long, ts long", "update", "EventTimeTimeout")


def start(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream into a table in memory until stop()."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()


def stop(query: StreamingQuery, seconds: int = 60) -> bool:
    """Stop a running query early; whether it has ended within the time. What it has written stays."""
    if query.isActive:
        query.stop()
    return not query.isActive or bool(query.awaitTermination(seconds))


def into_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of aggregates over all input that is there; the Parquet table at ``path`` is its whole result."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def available_now(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all input that is there, and give the result as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
