"""Tasks and their dependencies: a small builder, levels of the graph, and duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.plans.chunks import schedule
from tessera.sources.objects import written

SCHEMA = "id int, name string, length decimal(38,18), timeout decimal(38,0), resources array<string>, node string, duplicate_of string, duplicates array<string>, depends_on array<string>, start_time double"


@dataclass
class TaskGraph:
    """Tasks by name, in the order of their definition. Repeated resources and dependencies are kept once."""

    tasks: dict[str, dict] = field(default_factory=dict)
    sections: list[dict] = field(default_factory=list)
    _open: list[dict] = field(default_factory=list)

    def define(self, name: str, *depends_on: str, duration: float = 1, timeout: int = 1_000_000, resources: tuple[str, ...] = ()) -> TaskGraph:
        self.tasks[name] = {"length": duration, "timeout": timeout, "resources": list(dict.fromkeys(resources)), "depends_on": list(dict.fromkeys(depends_on))}
        return self

    def depend(self, name: str, *on: str) -> TaskGraph:
        task = self.tasks[name]
        task["depends_on"] = list(dict.fromkeys([*task["depends_on"], *on]))
        return self

    def prioritise(self, name: str, *resources: str) -> TaskGraph:
        """These resources come first, in this order; the task's others follow."""
        task = self.tasks[name]
        task["resources"] = list(dict.fromkeys([*resources, *task["resources"]]))
        return self

    @contextmanager
    def _section(self, kind: str, **more) -> Iterator[dict]:
        section = {"kind": kind, "inside": self._open[-1]["number"] if self._open else None, "number": len(self.sections), "tasks": [], **more}
        before = set(self.tasks)
        self.sections.append(section)
        self._open.append(section)
        try:
            yield section
        finally:
            self._open.pop()
            section["tasks"] = [t for t in self.tasks if t not in before]

    def parallel_for(self, lo: int, hi: int, strategy: str = "guided", **parameters: float):
        """A section whose loop is dealt out in chunks; the tasks defined inside belong to it."""
        return self._section("parallel for", lo=lo, hi=hi, strategy=strategy, parameters=parameters)

    def simulate(self):
        """A section whose tasks are only counted with their durations, not run."""
        return self._section("simulate")

    def chunks_of(self, section: dict, n: int) -> list[tuple[int, int, int, int, int]]:
        """The schedule of a parallel-for section on n nodes."""
        return schedule(section["strategy"], section["lo"], section["hi"], n, **section["parameters"])

    def simulated_length(self, section: dict) -> float:
        """The durations of a section's tasks, one after another."""
        return sum(self.tasks[t]["length"] for t in section["tasks"])

    def frame(self, spark: SparkSession) -> DataFrame:
        from decimal import Decimal

        rows = [(i, k, Decimal(str(t["length"])), Decimal(t["timeout"]), t["resources"], None, None, [], t["depends_on"], None) for i, (k, t) in enumerate(self.tasks.items(), 1)]
        return spark.createDataFrame(rows, SCHEMA)


def edges(tasks: DataFrame) -> DataFrame:
    return tasks.select("name", F.explode("depends_on").alias("needs"))


#: Rows of tasks and dependencies up to which the driver levels a graph.
SMALL = 50_000


def _levels_of(rows: list[tuple], most: int) -> dict:
    defined = {name for name, _ in rows}
    needs: dict = {name: set() for name in defined}
    for name, other in rows:
        if other in defined:
            needs[name].add(other)
    found, now, level = {}, [name for name, n in needs.items() if not n], 0
    needed_by: dict = {}
    for name, others in needs.items():
        for other in others:
            needed_by.setdefault(other, []).append(name)
    while now:
        if level > most:
            raise ValueError(f"more than {most} levels")
        found |= dict.fromkeys(now, level)
        after = []
        for name in now:
            for waiting in needed_by.get(name, ()):
                needs[waiting].discard(name)
                if not needs[waiting]:
                    after.append(waiting)
        now, level = after, level + 1
    if len(found) < len(defined):
        raise ValueError("the tasks depend on each other in a cycle")
    return found


def levels(tasks: DataFrame, most: int = 1000) -> DataFrame:
    """name, level: 0 without dependencies, else one more than the deepest dependency. A cycle raises ValueError.

    Names that aren't defined count as done. A graph of up to SMALL tasks and dependencies is levelled on the driver; a
    larger one by one join a level.
    """
    rows = tasks.select("name", F.explode_outer("depends_on").alias("needs")).limit(SMALL + 1).collect()
    if len(rows) <= SMALL:
        found = _levels_of([tuple(r) for r in rows], most)
        return tasks.sparkSession.createDataFrame(list(found.items()), StructType([tasks.schema["name"], StructField("level", IntegerType())]))
    waits = edges(tasks).join(tasks.select(F.col("name").alias("needs")), "needs", "left_semi").select("name", "needs")
    rest, level = tasks.select("name"), 0
    done: list[DataFrame] = []
    while rest.limit(1).count():
        if level > most:
            raise ValueError(f"more than {most} levels")
        ready = written(rest.join(waits, "name", "left_anti").withColumn("level", F.lit(level)), "levels")
        if not ready.limit(1).count():
            raise ValueError("the tasks depend on each other in a cycle")
        done.append(ready)
        rest = rest.join(ready, "name", "left_anti")
        waits = waits.join(ready.select(F.col("name").alias("needs")), "needs", "left_anti").select("name", "needs")
        level += 1
    out = done[0] if done else rest.withColumn("level", F.lit(0))
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def merge_tree(leaves: int = 20) -> TaskGraph:
    """Sort tasks for the leaves, then merges of two results at a time until one is left."""
    graph, now, n = TaskGraph(), [], 0
    for _ in range(leaves):
        n += 1
        graph.define(str(n), duration=n)
        now.append(str(n))
    while len(now) > 1:
        after = []
        for k in range(0, len(now) - 1, 2):
            n += 1
            graph.define(str(n), now[k], now[k + 1], duration=n)
            after.append(str(n))
        now = after + now[len(now) - len(now) % 2 :]
    return graph


def with_resources(tasks: DataFrame, more: Column) -> DataFrame:
    """Tasks with further resources; a resource is named once, in the order of its first mention."""
    return tasks.withColumn("resources", F.array_union("resources", more))


def is_duplicate(tasks: DataFrame, *more: Column) -> DataFrame:
    return tasks.select("name", F.col("duplicate_of").isNotNull().alias("is_duplicate"), (F.size("duplicates") > 0).alias("has_duplicates"), *more)


#: A task's JSON form: its field and the column.
WIRE = {"id": "id", "nodeUUID": "node", "name": "name", "length": "length", "timeout": "timeout", "resources": "resources", "dependOn": "depends_on", "startTime": "start_time"}


def to_json(tasks: DataFrame, *keys: str) -> DataFrame:
    """Tasks as JSON objects in the column ``json``, beside the keys; lengths as doubles, timeouts as longs."""
    kinds = {"length": "double", "timeout": "long"}
    fields = [F.col(c).cast(kinds[c]).alias(f) if c in kinds else F.col(c).alias(f) for f, c in WIRE.items()]
    flags = [(F.size("duplicates") > 0).alias("hasDuplicates"), F.col("duplicate_of").isNotNull().alias("isDuplicate")]
    return tasks.select(*keys, F.to_json(F.struct(*fields, *flags)).alias("json"))


def distinct_tasks(tasks: DataFrame) -> DataFrame:
    """One of all tasks that are equal but for id, node and dependencies: the one with the least id."""
    keys = ["name", "length", "timeout", "resources", "start_time"]
    return tasks.groupBy(*keys).agg(F.min("id").alias("id"))
