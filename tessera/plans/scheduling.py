"""Schedulers: what deals chunks and tasks to nodes. Any class with these two methods is one."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import chunks


class Scheduler(Protocol):
    def schedule(self, nodes: DataFrame, tasks: DataFrame, settings: dict[str, Any]) -> DataFrame: ...

    def schedule_range(self, nodes: DataFrame, lo: int, hi: int, settings: dict[str, Any]) -> DataFrame: ...


@dataclass
class RoundRobin:
    """Chunks of a strategy, or tasks in order of their ids, to nodes in order of their ids.

    A schedule has one row for each chunk or task; node numbers are few, as they are the machines of a cluster.
    """

    strategy: str = "guided"
    errors: list[str] = field(default_factory=list)

    def _numbered(self, nodes: DataFrame) -> tuple[DataFrame, int]:
        found = nodes.select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("long").alias("_at"))
        return found, found.count()

    def _deal(self, rows: DataFrame, order: str, nodes: DataFrame) -> DataFrame:
        numbered, n = self._numbered(nodes)
        if not n:
            self.errors.append("there are no nodes")
            return rows.withColumn("node", F.lit(None).cast(nodes.schema["node"].dataType))
        at = F.pmod(F.col(order).cast("long"), F.lit(n))
        return rows.withColumn("_at", at).join(numbered, "_at").drop("_at")

    def schedule(self, nodes: DataFrame, tasks: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
        return self._deal(tasks, "id", nodes)

    def schedule_range(self, nodes: DataFrame, lo: int, hi: int, settings: dict[str, Any] | None = None) -> DataFrame:
        n = max(nodes.count(), 1)
        plan = chunks.chunks(nodes.sparkSession, self.strategy, lo, hi, n, **(settings or {}))
        return self._deal(plan.withColumn("id", F.col("chunk_no") - 1), "id", nodes).drop("id")


def summary(nodes: DataFrame, schedule: DataFrame) -> DataFrame:
    """Nodes, rows of a schedule, nodes that it uses, and nodes that are left as backups."""
    used = schedule.agg(F.count("*").alias("n"), F.count_distinct("node").alias("used"))
    total = nodes.agg(F.count_distinct("node").alias("total_nodes"))
    return total.select("total_nodes", used.select("n").scalar().alias("total_chunks"), used.select("used").scalar().alias("selected_nodes")).withColumn("backup_nodes", F.col("total_nodes") - F.col("selected_nodes"))
