"""Chunk schedules of a one-dimensional range of integers, or of real numbers with unit steps (at the end).

A range has inclusive bounds; sizes are computed from D = hi - lo, so the range holds D + 1 integers. A schedule is a
small table (chunk_no from 1, planned_size, low, up, n_elements); planned_size is the size as the strategy states it and
n_elements = up - low + 1 what the chunk holds. All strategies cover the range exactly once. Reverse schedules mirror
the forward ones. Sizes that can't cover the range raise ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.objects import written

SCHEMA = "chunk_no int, planned_size long, low long, up long, n_elements long"
#: Chunks of a schedule, at most: schedules are made on the driver and broadcast.
MOST_CHUNKS = 1_000_000


def _div(a: int, b: int) -> int:
    """Division that truncates toward zero."""
    if b == 0:
        raise ValueError("the schedule's parameters divide by zero")
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def equal(lo: int, hi: int, n: int) -> list[tuple[int, int, int]]:
    """n chunks of D div n; every planned size is D. With D < n the chunks between the first and the last are empty."""
    q = (hi - lo) // n
    return [(hi - lo, lo + q * (i - 1) + (i > 1), hi if i == n else lo + q * i) for i in range(1, n + 1)]


def _laid(lo: int, hi: int, sizes: Iterator[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Chunks with the given (planned, actual) sizes, one after the other, the last one cut at hi."""
    out, low = [], lo
    for planned, size in sizes:
        if size <= 0:
            raise ValueError("the chunk sizes reach zero before the range ends")
        if len(out) >= MOST_CHUNKS:
            raise ValueError(f"more than {MOST_CHUNKS} chunks")
        up = min(low + size - 1, hi)
        out.append((planned, low, up))
        if up == hi:
            return out
        low = up + 1
    raise ValueError("the chunk sizes end before the range")


def guided(lo: int, hi: int, n: int) -> list[tuple[int, int, int]]:
    """Each chunk is the remaining D over n, rounded up; the planned size is taken before the minimum of 1."""

    def sizes():
        left = hi - lo
        while True:
            planned = _ceil(left, n)
            yield planned, max(planned, 1)
            left -= max(planned, 1)

    return _laid(lo, hi, sizes())


def factoring(lo: int, hi: int, n: int) -> list[tuple[int, int, int]]:
    """Batches of n chunks, each of half the remaining D over n, rounded up."""

    def sizes():
        left = hi - lo
        while True:
            size = max(_ceil(left, 2 * n), 1)
            for _ in range(n):
                yield size, size
            left -= size * n

    return _laid(lo, hi, sizes())


def trapezoid(lo: int, hi: int, n: int, first: float = 0.0625, last: float = 0.01) -> list[tuple[int, int, int]]:
    """Sizes fall by a constant from first * D toward last * D, and on below it if the range isn't at its end.

    The constant comes from truncated divisions, so the sizes can sum to less than the range (0.9986 of a long one, as a
    rule, with the factors given here). Then the smallest size above zero is repeated, unless last * D is below 1: such
    sizes are meant to reach zero.
    """
    d = hi - lo
    f, l = int(first * d), int(last * d)
    step = _div(f - l, _div(2 * d, f + l) - 1)

    def sizes():
        size = f
        while True:
            yield size, size
            if size > step or l <= 0:
                size -= step

    return _laid(lo, hi, sizes())


def quadratic(lo: int, hi: int, n: int, delta: float = 2.0, last: float = 0.01) -> list[tuple[int, int, int]]:
    """Sizes follow a quadratic through the first, a middle and the last size; at least 1."""
    d = hi - lo
    if delta == 0:
        raise ValueError("delta is zero")
    f, l = d // (2 * n), max(int(last * d), 1)
    return _laid(lo, hi, quadratic_sizes(d, f, l, int((f + l) / delta // 1)))


def quadratic_sizes(d: int, f: int, l: int, middle: int) -> Iterator[tuple[int, int]]:
    m = _div(6 * d, 4 * middle + l + f)
    b, c = _div(4 * middle - l - 3 * f, m), _div(2 * f + 2 * l - 4 * middle, m * m)
    i = 1
    while True:
        size = max(f if i == 1 else f + b * i + c * i * i, 1)
        yield size, size
        i += 1


STRATEGIES: dict[str, Callable[..., list[tuple[int, int, int]]]] = {
    "equal": equal, "guided": guided, "factoring": factoring, "trapezoid": trapezoid, "quadratic": quadratic, "even": equal,
}


def schedule(strategy: str, lo: int, hi: int, n: int, reverse: bool = False, **parameters: float) -> list[tuple[int, int, int, int, int]]:
    """Rows of SCHEMA. One node gets one chunk, whatever the strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
    if n < 1 or hi < lo:
        raise ValueError("a schedule needs at least one node and hi >= lo")
    rows = [(hi - lo, lo, hi)] if n == 1 else STRATEGIES[strategy](lo, hi, n, **parameters)
    if reverse:
        rows = [(size, lo + hi - up, lo + hi - low) for size, low, up in rows]
    return [(i, size, low, up, up - low + 1) for i, (size, low, up) in enumerate(rows, 1)]


def chunks(spark: SparkSession, strategy: str, lo: int, hi: int, n: int, reverse: bool = False, **parameters: float) -> DataFrame:
    return spark.createDataFrame(schedule(strategy, lo, hi, n, reverse, **parameters), SCHEMA)


def bounds(df: DataFrame, key: str) -> tuple[int, int]:
    """Least and greatest key; (0, 0) of an empty table."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    return (0, 0) if lo is None else (lo, hi)


def assign_equal(df: DataFrame, key: str, lo: int, hi: int, n: int) -> DataFrame:
    """Add chunk_no of an equal schedule by arithmetic: no join."""
    q = (hi - lo) // n
    if n == 1:
        return df.withColumn("chunk_no", F.lit(1))
    if q == 0:
        return df.withColumn("chunk_no", F.when(F.col(key) == lo, 1).otherwise(n))
    at = F.expr(f"(`{key}` - {lo} - 1) div {q}")
    return df.withColumn("chunk_no", (F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)) + 1).cast("int"))


def assign(df: DataFrame, key: str, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Add chunk_no of any schedule: a broadcast hash join on key buckets, then a comparison with the chunk's bounds.

    Buckets are as wide as the mean chunk, so the broadcast table has fewer than 2 * len(plan) + 2 rows; schedules have
    MOST_CHUNKS rows at most.
    """
    spark = df.sparkSession
    lo, hi = min(r[2] for r in plan), max(r[3] for r in plan)
    width = max(1, (hi - lo) // len(plan))
    rows = [(r[0], r[2], r[3], b) for r in plan if r[4] > 0 for b in range((r[2] - lo) // width, (r[3] - lo) // width + 1)]
    small = F.broadcast(spark.createDataFrame(rows, "chunk_no int, _low long, _up long, _bucket long"))
    bucketed = df.withColumn("_bucket", F.expr(f"(`{key}` - {lo}) div {width}"))
    return bucketed.join(small, "_bucket").where(F.col(key).between(F.col("_low"), F.col("_up"))).drop("_bucket", "_low", "_up")


def aggregate(df: DataFrame, key: str, value: str, strategy: str, n: int, reverse: bool = False, **parameters: float) -> DataFrame:
    """Rows and sum of ``value`` for each chunk of the key range, empty chunks too."""
    lo, hi = bounds(df, key)
    plan = schedule(strategy, lo, hi, n, reverse, **parameters)
    rows = df.select(key, value)
    placed = assign_equal(rows, key, lo, hi, n) if strategy in ("equal", "even") and not reverse else assign(rows, key, plan)
    sums = placed.groupBy("chunk_no").agg(F.count("*").alias("n_rows"), F.sum(value).alias("total"))
    table = df.sparkSession.createDataFrame(plan, SCHEMA)
    return table.join(sums, "chunk_no", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))


def non_increasing(chunks_df: DataFrame, *by: str) -> DataFrame:
    """Whether the planned sizes never rise, for each value of ``by``."""
    size = F.col("planned_size")
    before = F.lag("planned_size").over(Window.partitionBy(*by).orderBy("chunk_no"))
    return chunks_df.withColumn("_ok", F.coalesce(size <= before, F.lit(True))).groupBy(*by).agg(F.bool_and("_ok").alias("non_increasing"), F.count("*").cast("long").alias("n_chunks"))


def replicas(chunks_df: DataFrame, copies: int) -> DataFrame:
    """Each chunk and its copies: replica_id, duplicate_of (null for the original)."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy")
    named = chunks_df.select("*", copy)
    return named.select(
        "chunk_no", "low", "up", "copy", F.format_string("chunk-%d-%d", "chunk_no", "copy").alias("replica_id"),
        F.when(F.col("copy") > 0, F.format_string("chunk-%d-0", F.col("chunk_no"))).alias("duplicate_of"),
    )


def delta_sweep(spark: SparkSession, d: int = 1001, nodes: range = range(2, 26), last: float = 0.1, low: int = -10, high: int = 10, per_unit: int = 10_000) -> DataFrame:
    """The deltas of quadratic schedules whose number of chunks is new, in order of (nodes, delta).

    A schedule counts if its sizes never rise and it has fewer than 5 * nodes chunks; it is reported if its number of
    chunks differs from that of the one before that counts. Deltas with equal middle size share a schedule, and they
    follow each other: a task takes one number of nodes and lays the schedules of all its middle sizes in step.
    """
    tail = max(int(last * d), 1)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        delta = np.arange(low * per_unit, high * per_unit) / per_unit
        delta = delta[delta != 0]
        for n in (int(n) for pdf in frames for n in pdf.nodes):
            middle = np.floor((d // (2 * n) + tail) / delta).astype(np.int64)
            begins = np.flatnonzero(np.concatenate([[True], middle[1:] != middle[:-1]]))
            count = lengths_of_quadratics(d, n, tail, middle[begins])
            begins, count = begins[count > 0], count[count > 0]
            new = np.concatenate([np.ones(min(1, len(count)), bool), count[1:] != count[:-1]])
            yield pd.DataFrame({"nodes": n, "delta": delta[begins[new]], "n_chunks": count[new].astype(np.int32), "_end": count[-1] if len(count) else 0, "_first": np.arange(int(new.sum())) == 0})

    found = spark.range(nodes.start, nodes.stop, 1, len(nodes)).withColumnRenamed("id", "nodes").mapInPandas(judge, "nodes int, delta double, n_chunks int, _end int, _first boolean")
    found = written(found, "deltas")
    ends = found.where("_first").select("nodes", F.lag("_end", 1, 0).over(Window.orderBy("nodes")).alias("_before"))  # one row for each number of nodes
    return found.join(ends, "nodes").where("not _first or n_chunks <> _before").select("nodes", "delta", "n_chunks")


def lengths_of_quadratics(d: int, n: int, tail: int, middle: np.ndarray) -> np.ndarray:
    """Chunks of quadratic schedules with these middle sizes, 0 for one that doesn't count."""
    first = d // (2 * n)
    quotient = lambda a, b: np.where(b == 0, 0, np.sign(a) * np.sign(b) * (np.abs(a) // np.maximum(np.abs(b), 1)))
    m = quotient(np.int64(6 * d), 4 * middle + tail + first)
    b, c = quotient(4 * middle - tail - 3 * first, m), quotient(2 * first + 2 * tail - 4 * middle, m * m)
    count, size, done = np.zeros(len(m), np.int64), np.full(len(m), first), np.full(len(m), first)
    open_ = m != 0
    for i in range(1, 5 * n):
        full = open_ & (done > d)
        count[full] = i
        open_ &= ~full
        if not open_.any():
            break
        new = np.maximum(first + b * (i + 1) + c * (i + 1) ** 2, 1)
        open_ &= new <= size  # sizes as planned, the last one too
        size, done = new, done + new
    return count


# ---- ranges of real numbers --------------------------------------------------------------------------------------

REAL_SCHEMA = "chunk_no int, planned_size double, low double, up double"


def schedule_real(strategy: str, lo: float, hi: float, n: int, reverse: bool = False, single: bool = False, **parameters: float) -> list[tuple[int, float, float, float]]:
    """Rows of REAL_SCHEMA for a loop over real numbers, in double or single precision.

    The loop steps by one: a chunk starts one above the end of the chunk before, and what lies between belongs to none.
    Nothing is rounded to whole numbers but the sizes of guided and factoring chunks, which are rounded up. Reverse
    schedules mirror the forward ones. Sizes that can't cover the range raise ValueError.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
    if n < 1 or not hi >= lo or not np.isfinite([lo, hi]).all():
        raise ValueError("a schedule needs at least one node and finite bounds with hi >= lo")
    real = np.float32 if single else np.float64
    lo, hi = real(lo), real(hi)
    d = hi - lo
    if n == 1:
        rows = [(d, lo, hi)]
    elif strategy in ("equal", "even"):
        q = d / real(n)
        rows = [(d, lo + (q * real(i - 1) + real(i > 1)), hi if i == n else lo + q * real(i)) for i in range(1, n + 1)]
    else:
        rows = _laid_real(lo, hi, _REAL_SIZES[strategy](real, d, n, **parameters))
    if reverse:
        rows = [(size, lo + hi - up, lo + hi - low) for size, low, up in rows]
    return [(i, float(size) + 0.0, float(low), float(up)) for i, (size, low, up) in enumerate(rows, 1)]


def _laid_real(lo, hi, sizes: Iterator) -> list[tuple]:
    out, low = [], lo
    for planned, size in sizes:
        up = low + size - type(lo)(1)
        if out and not up > out[-1][2] or not np.isfinite(up):
            raise ValueError("the chunk sizes reach zero before the range ends")
        if len(out) >= MOST_CHUNKS:
            raise ValueError(f"more than {MOST_CHUNKS} chunks")
        out.append((planned, low, min(up, hi)))
        if up >= hi:
            return out
        low = up + type(lo)(1)
    raise ValueError("the chunk sizes end before the range")


def _guided_real(real: type, left, n: int):
    while True:
        planned = real(np.ceil(float(left) / n))
        size = max(planned, real(1))
        yield planned, size
        left = left - size


def _factoring_real(real: type, left, n: int):
    while True:
        size = max(real(np.ceil(float(left) / (2 * n))), real(1))
        for _ in range(n):
            yield size, size
        left = left - size * real(n)


def _trapezoid_real(real: type, d, n: int, first: float = 0.0625, last: float = 0.01):
    f, l = real(first * float(d)), real(last * float(d))
    if f + l == 0:
        raise ValueError("the schedule's parameters divide by zero")
    m = real(2) * d / (f + l)
    if m == 1:
        raise ValueError("the schedule's parameters divide by zero")
    step, size = (f - l) / (m - real(1)), f
    while True:
        yield size, size
        size = size - step


def _quadratic_real(real: type, d, n: int, delta: float = 2.0, last: float = 0.01):
    f, l = d / real(2 * n), max(real(last * float(d)), real(1))
    if delta == 0:
        raise ValueError("delta is zero")
    middle = real(float(f + l) / delta)
    whole = real(4) * middle + l + f
    if whole == 0 or d == 0:
        raise ValueError("the schedule's parameters divide by zero")
    m = real(6) * d / whole
    b, c = (real(4) * middle - l - real(3) * f) / m, (real(2) * f + real(2) * l - real(4) * middle) / (m * m)
    i = 1
    while True:
        size = max(f if i == 1 else f + b * real(i) + c * real(i * i), real(1))
        yield size, size
        i += 1


_REAL_SIZES = {"guided": _guided_real, "factoring": _factoring_real, "trapezoid": _trapezoid_real, "quadratic": _quadratic_real}


def aggregate_real(df: DataFrame, key: str, strategy: str, n: int, reverse: bool = False, single: bool = False, **parameters: float) -> DataFrame:
    """Chunks of the range of a real key, with the number of rows and the least and greatest key in each.

    Rows meet chunks by a broadcast hash join on key buckets as wide as the mean chunk; keys between chunks, null and NaN
    keys are in none. In single precision keys are compared with the chunks' rounded bounds.
    """
    spark = df.sparkSession
    keys = df.select(F.col(key).cast("double").alias("_key")).where(F.col("_key").isNotNull() & ~F.isnan("_key"))
    lo, hi = bounds(keys, "_key")
    plan = schedule_real(strategy, lo, hi, n, reverse, single, **parameters)
    low = min(r[2] for r in plan)
    width = max((max(r[3] for r in plan) - low) / len(plan), 1.0)
    at = lambda x: int((x - low) // width)
    rows = [(r[0], r[2], r[3], b) for r in plan if r[3] >= r[2] for b in range(at(r[2]) - 1, at(r[3]) + 2)]
    small = F.broadcast(spark.createDataFrame(rows, "chunk_no int, _low double, _up double, _bucket long"))
    placed = keys.withColumn("_bucket", F.floor((F.col("_key") - low) / width)).join(small, "_bucket").where(F.col("_key").between(F.col("_low"), F.col("_up")))
    found = placed.groupBy("chunk_no").agg(F.count("*").alias("n_rows"), F.min("_key").alias("least"), F.max("_key").alias("most"))
    table = spark.createDataFrame(plan, REAL_SCHEMA)
    return table.join(found, "chunk_no", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
