"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, kept

#: Edges of a task in a round, at least; a small graph is worked on by 8 tasks, whatever the shuffle partitions.
EDGES_A_FILE = 500_000


def connected(edges: DataFrame, first: str = "a", second: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that an edge names; component is the least id reachable.

    Every round writes its edges to the shared folder and ends when a round changes nothing. A node's least neighbour is
    a partial aggregate, and it is written before edges are joined with it: both sides of such a join then come straight
    from an exchange, and Spark's skew join deals the edges of a node with very many out to several tasks. Loops,
    repeated edges and edges with a null end are allowed; those with a null end say nothing. No edges give no rows.
    """
    spark = edges.sparkSession
    kind = edges.schema[first].dataType.simpleString()
    pairs = edges.select(F.col(first).cast(kind).alias("a"), F.col(second).cast(kind).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select("a").distinct()
    # an edge is (a, b) with a > b
    now, path = kept(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(now)

    def held(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        return kept(df.coalesce(max(8, seen[0] // EDGES_A_FILE)), label)

    for _ in range(most_rounds if seen[0] else 0):
        # large star: a goes to the least neighbour of b, if that is below b
        least, least_path = held(now.groupBy("a").agg(F.min("b").alias("m")), "least")
        large, large_path = held(now.join(least.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b")), "large")
        # small star: a and its smaller neighbours go to the least of them
        lower, lower_path = held(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        star = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(lower, "a").select(F.explode(star).alias("e")).select("e.a", "e.b")
        before, (now, path) = path, held(small.where("a <> b").distinct(), "edges")
        erase(spark, before, least_path, large_path, lower_path)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        if seen[0]:
            raise RuntimeError(f"the components haven't settled after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    alone = loops.select(F.col("a").alias("id"), F.col("a").alias("component"))
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
    return found.unionByName(alone.join(found, "id", "left_anti"))


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components as edges from the least id of each: what a task can settle needs no round."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(root(x), x) for x in up if root(x) != x]


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a checksum that doesn't depend on their order."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.sum((h % 1_000_003).cast("long"))).first())
