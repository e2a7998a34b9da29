"""Table functions that SQL can call once they are registered."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.plans import chunks


@udtf(returnType=chunks.SCHEMA)
class ChunkPlan:
    """chunk_plan(lo, hi, n, strategy): the chunks of a range."""

    def eval(self, lo: int, hi: int, n: int, strategy: str) -> Iterator[tuple]:
        yield from chunks.schedule(strategy, lo, hi, n)


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_plan", ChunkPlan)
