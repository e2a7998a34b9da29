"""Nodes, addresses and routes: upserts, expiry, nearest hops, distances, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPIRY_SECONDS = 600
NO_HOP, FAR = "Empty", (1 << 63) - 1


def strip_zone(ip: Column) -> Column:
    return F.substring_index(ip, "%", 1)


def age_seconds(as_of: Column, ts: Column) -> Column:
    """Whole seconds between two times, truncated."""
    return F.expr("0") + F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000)


def upsert_hops(hops: DataFrame) -> DataFrame:
    """The latest distance and time of each (dst, via); on equal times the row with the greatest ordinal."""
    latest = F.max_by(F.struct("distance", "ts"), F.struct("ts", "ordinal"))
    return hops.groupBy("dst", "via").agg(latest.alias("h")).select("dst", "via", "h.distance", "h.ts")


def expire(hops: DataFrame, as_of: Column, seconds: int = EXPIRY_SECONDS) -> DataFrame:
    return hops.where(age_seconds(as_of, F.col("ts")) < seconds)


def remove_hop(hops: DataFrame, via: str) -> DataFrame:
    return hops.where(F.col("via") != via)


def nearest(hops: DataFrame, destinations: DataFrame) -> DataFrame:
    """The nearest hop of each destination (ties: least via); one named Empty, infinitely far, if there is none."""
    least = hops.groupBy("dst").agg(F.min(F.struct("distance", "via")).alias("h"))
    joined = destinations.select("dst").join(least, "dst", "left")
    return joined.select("dst", F.coalesce("h.via", F.lit(NO_HOP)).alias("via"), F.coalesce("h.distance", F.lit(FAR).cast("long")).alias("distance"))


def distances(nodes: DataFrame, adjacent: DataFrame, hops: DataFrame) -> DataFrame:
    """A node's distance: of its adjacent entry, else of its nearest hop, else the last one known (default 0)."""
    near = hops.groupBy(F.col("dst").alias("node")).agg(F.min("distance").alias("_hop"))
    joined = nodes.join(adjacent.select("node", F.col("distance").alias("_adjacent")), "node", "left").join(near, "node", "left")
    return joined.select("node", F.coalesce("_adjacent", "_hop", "last_distance", F.lit(0).cast("long")).alias("distance"))


def put_if_absent(addresses: Column, ip: Column, entry: Column) -> Column:
    return F.when(F.map_contains_key(addresses, ip), addresses).otherwise(F.map_concat(addresses, F.create_map(ip, entry)))


def remove_ip(addresses: Column, ip: Column) -> Column:
    return F.map_filter(addresses, lambda k, _: k != ip)


def get_ip(addresses: Column, ip: Column) -> Column:
    return F.try_element_at(addresses, ip)


def cpu_score(benchmarks: Column) -> Column:
    return F.get_json_object(benchmarks, "$.CPU.Benchmarks['Composite Score']").cast("double")


def speed(benchmarks: Column, path: str = "$.HDD.Benchmarks.AvgRead") -> Column:
    """The first word of a value such as '123.4 MB/s', as a number."""
    return F.try_element_at(F.split(F.get_json_object(benchmarks, path), r"\s+"), F.lit(1)).cast("double")


NODE_WIRE = "struct<uuid:string,host:string,os:string,taskLimit:int,memory:bigint,lastCheckAgo:bigint,CPULOAD:double,ipAddresses:array<struct<ip:string,pingScore:bigint,distance:bigint>>>"


def ping_scores(pings: DataFrame, ok: Column, *by: str) -> DataFrame:
    """The score of each address: one up for each ping that came back, one down for each that didn't."""
    return pings.groupBy(*by).agg(F.sum(F.when(ok, 1).otherwise(-1)).alias("ping_score"))


def parse_nodes(rows: DataFrame, column: str, as_of_ms: Column) -> DataFrame:
    """Nodes of a JSON column: zones of addresses are dropped, a missing load is the largest double."""
    n = rows.select(F.from_json(column, NODE_WIRE).alias("n")).where("n.uuid is not null")
    entry = lambda a: F.struct(strip_zone(a["ip"]).alias("key"), F.struct(F.coalesce(a["pingScore"], F.lit(0).cast("long")).alias("ping_score"), F.coalesce(a["distance"], F.lit(0).cast("long")).alias("distance")).alias("value"))
    return n.select(
        "n.uuid", "n.host", "n.os", F.col("n.taskLimit").alias("task_limit"), "n.memory", (as_of_ms - F.col("n.lastCheckAgo")).alias("last_checked_ms"),
        F.coalesce("n.CPULOAD", F.lit(1.7976931348623157e308)).alias("cpu_load"),
        F.map_from_entries(F.transform(F.coalesce("n.ipAddresses", F.array().cast("array<struct<ip:string,pingScore:bigint,distance:bigint>>")), entry)).alias("addresses"),
    )


def latest(rows: DataFrame, key: str, at: str, ordinal: str) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(at, ordinal)).alias("r")).select(key, "r.*")


def to_json(rows: DataFrame, *keys: str, pretty: bool = False, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of any entity as JSON objects in the column ``json``, beside the keys; null fields are left out. Of the keys
    those in ``keep`` (all, by default) are fields too."""
    fields = [c for c in rows.columns if c not in keys or keep is None or c in keep]
    return rows.select(*keys, F.to_json(F.struct(*fields), {"pretty": str(pretty).lower()}).alias("json"))
