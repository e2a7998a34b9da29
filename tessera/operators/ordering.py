"""Orders by named keys, ranks, and a global sort by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.objects import written

from .network import cpu_score, speed

_bench = lambda name: F.get_json_object("benchmarks", f"$.CPU.Benchmarks['{name}']").cast("double")

#: Sort keys by entity; each gives the expression of a row.
NODE_KEYS: dict[str, Column] = {}
TASK_KEYS: dict[str, Column] = {}
HOP_KEYS = {"DISTANCE": "distance", "TIMESTAMP": "ts"}
IP_KEYS = {"IP": "ip", "DISTANCE": "distance", "PING_SCORE": "ping_score"}


def node_keys() -> dict[str, Column]:
    plain = {"UUID": "uuid", "OS": "os", "HOST": "host", "QLEN": "task_limit", "QWAIT": "waiting", "RAM": "memory", "RAM_FREE": "free_memory", "DISTANCE_FROM_CURRENT": "distance", "HDD_FREE": "hdd_free", "HDD": "hdd_size", "CPU_AVG_LOAD": "cpu_load", "PROCESSOR": "processor"}
    scores = {"CPU_MONTE_CARLO": "Monte Carlo", "CPU_FFT": "FFT", "CPU_LU": "LU", "CPU_SOR": "SOR", "CPU_SPARSE_MAT_MUL": "Sparse MatMult"}
    return {k: F.col(v) for k, v in plain.items()} | {k: _bench(v) for k, v in scores.items()} | {
        "CPU_COMPOSITE_SCORE": cpu_score(F.col("benchmarks")), "HDD_READ_SPEED": speed(F.col("benchmarks")), "HDD_WRITE_SPEED": speed(F.col("benchmarks"), "$.HDD.Benchmarks.AvgWrite"),
    }


def task_keys() -> dict[str, Column]:
    return {"NAME": F.col("name"), "NO_OF_FILES": F.size("files"), "WEIGHT": F.col("length"), "TIMEOUT": F.col("timeout"), "ID": F.col("id"), "NO_OF_RESOURCES": F.size("resources"), "START_TIME": F.col("start_time"), "NO_OF_DEPENDENCIES": F.size("depends_on")}


def hop_keys() -> dict[str, Column]:
    return {k: F.col(v) for k, v in HOP_KEYS.items()}


def ip_keys() -> dict[str, Column]:
    return {k: F.col(v) for k, v in IP_KEYS.items()}


def comparator(keys: dict[str, Column], *wanted: str) -> list[Column]:
    """Orders for names of keys; a name with a leading - is descending."""
    out = []
    for name in wanted:
        key = name.lstrip("-").upper()
        if key not in keys:
            raise ValueError(f"unknown key {name!r}; known: {', '.join(sorted(keys))}")
        out.append(keys[key].desc() if name.startswith("-") else keys[key].asc())
    return out


def top(df: DataFrame, orders: list[Column], k: int) -> DataFrame:
    """The first k rows with their position from 1: only k rows of each partition are compared at the end."""
    first = df.orderBy(*orders).limit(k)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*orders)).cast("int"))


def ranked(df: DataFrame, orders: list[Column], *by: str) -> DataFrame:
    """Position of each row (from 1) in its group."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*orders)).cast("int"))


def placed(df: DataFrame, orders: list[Column]) -> DataFrame:
    """Position of each row (from 1) among all rows.

    Rows are dealt by ranges of the whole order; positions are counted within a range and shifted by the ranges before,
    so no task sees all rows. The ranges are written first, as other bounds may be drawn when they are computed again.
    """
    ranges = written(df.repartitionByRange(*orders).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes, before, start = ranges.groupBy("_range").count().collect(), {}, 0
    for k, n in sorted(sizes):
        before[k], start = start, start + n
    if not before:
        return df.withColumn("position", F.lit(1).cast("long"))
    shift = F.element_at(F.create_map(*[F.lit(x) for k, s in before.items() for x in (k, s)]), F.col("_range"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*orders))
    return ranges.withColumn("position", (shift + own).cast("long")).drop("_range")


def range_sort(df: DataFrame, *keys: str) -> DataFrame:
    """A global ascending sort: one range exchange, then every partition sorts its own range."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def as_sorted(ordered: DataFrame) -> DataFrame:
    """The rows of a range sort with ``position``: their place (from 1) in its output, range after range.

    The ranges are written first; a row keeps its number within its range, and one count for each range shifts it.
    """
    part, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranges = written(ordered.withColumns({"_range": part, "_row": row}), "sorted")
    before, start = {}, 0
    for k, n in sorted(ranges.groupBy("_range").count().collect()):
        before[k], start = start, start + n
    if not before:
        return ordered.withColumn("position", F.lit(1).cast("long"))
    shift = F.element_at(F.create_map(*[F.lit(x) for k, s in before.items() for x in (k, s)]), F.col("_range"))
    return ranges.withColumn("position", (shift + F.col("_row") + 1).cast("long")).drop("_range", "_row")


def bag_union(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, as often as they occur."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def positions(df: DataFrame, keys: dict[str, Column], last: str, *by: str) -> DataFrame:
    """For every key of ``keys`` a column position_<key>: each row's place (from 1) in its group by that key, ties by the
    column ``last``. One exchange by the group serves them all."""
    place = lambda k: F.row_number().over(Window.partitionBy(*by).orderBy(k.asc(), F.col(last).asc())).cast("int")
    return df.select("*", *(place(k).alias(f"position_{name.lower()}") for name, k in keys.items()))


def global_ranks(df: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """(key, first_rank, n): rank in the sorted bag of keys of each distinct key's first occurrence, from 1.

    Equal keys are counted first; ranks are counted within value buckets and shifted by the buckets before, so no task
    sees all keys.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    lo, hi = counts.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return counts.select(key, F.lit(1).cast("long").alias("first_rank"), "n")
    bucket = F.least(F.floor((F.col(key) - lo) * buckets / (hi - lo + 1)), F.lit(buckets - 1)).cast("int")
    counts = counts.withColumn("_bucket", bucket)
    sizes, before, start = counts.groupBy("_bucket").agg(F.sum("n")).collect(), {}, 0
    for b, n in sorted(sizes):
        before[b], start = start, start + n
    shift = F.element_at(F.create_map(*[F.lit(x) for b, s in before.items() for x in (b, s)]), F.col("_bucket"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(key, (shift + own + 1).cast("long").alias("first_rank"), "n")
