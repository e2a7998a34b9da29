"""Devices: lenient parsing, filters, ranking, description and classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Preference of each device type (fixed values).
PREFERENCE = {"CPU": 0, "NPU": 1, "INTEGRATED_GPU": 2, "APU": 2, "FPGA": 3, "DISCRETE_GPU": 4, "OTHER": 0}
#: What describes no devices (fixed value).
NO_DEVICES = "No compute devices detected"
GPU_TYPES = ("INTEGRATED_GPU", "APU", "DISCRETE_GPU")
BACKENDS = ("OPENCL", "CUDA", "ROCM", "METAL", "VULKAN", "NPU", "JAVA_CPU")
WIRE = "array<struct<backend:string,id:string,name:string,vendor:string,type:string,computeUnits:int,memory:bigint>>"


def preference(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PREFERENCE.items() for x in kv]), kind), F.lit(0))


def is_gpu(kind: Column) -> Column:
    return kind.isin(*GPU_TYPES)


def capacity(units: Column, memory: Column) -> Column:
    """Compute units times MiB of memory, 1 MiB at least."""
    return units.cast("long") * F.greatest(F.lit(1).cast("long"), F.shiftright(memory, 20))


def of_type(devices: DataFrame, kind: str) -> DataFrame:
    return devices.where(F.col("type") == kind)


def of_backend(devices: DataFrame, backend: str) -> DataFrame:
    return devices.where(F.col("backend") == backend)


def best(devices: DataFrame, *by: str) -> DataFrame:
    """The best device (of each ``by``): most preferred type, then capacity; ties go to the least ``ordinal``."""
    rank = F.struct(preference(F.col("type")), capacity(F.col("units"), F.col("memory")), -F.col("ordinal"))
    rows = devices.groupBy(*by).agg(F.max_by(F.struct(*devices.columns), rank).alias("d")).where("d is not null")
    return rows.select("d.*")


def describe(devices: DataFrame, *by: str) -> DataFrame:
    """One row (for each ``by``), one line for each device in order of ``ordinal``; without ``by`` a message if there is
    none."""
    line = F.format_string("%s:%s (%s, %d CUs, %d MB)", "backend", "name", "type", "units", F.shiftright("memory", 20))
    lines = devices.select(*by, "ordinal", line.alias("line"))
    joined = lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("description"))
    return joined.select(*by, F.when(F.col("description") == "", NO_DEVICES).otherwise(F.col("description")).alias("description"))


def describe_unavailable(backends: DataFrame) -> DataFrame:
    """A line 'name: reason' for each backend that isn't available."""
    lines = backends.where(~F.col("available")).select("ordinal", F.format_string("%s: %s", "backend", "reason").alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("description"))


def normalise(devices: DataFrame, strict: bool = False) -> DataFrame:
    """Names and vendors are trimmed, blank ones say that they are unknown. Rows without an id go, or with ``strict`` end
    the query with an error."""
    blank = lambda c, text: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", text).otherwise(F.trim(F.col(c)))
    named = F.trim(F.coalesce("id", F.lit(""))) != ""
    rows = devices.withColumn("id", F.when(named, F.col("id")).otherwise(F.raise_error(F.lit("a device needs an id")))) if strict else devices.where(named)
    return rows.withColumns({"name": blank("name", "Unknown device"), "vendor": blank("vendor", "Unknown vendor")})


def parse(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Devices of a JSON array column. Entries without a known backend or type, or without an id, are left out."""
    entry = F.posexplode(F.from_json(column, WIRE, {"mode": "PERMISSIVE"})).alias("ordinal", "d")
    ok = F.col("d.backend").isin(*BACKENDS) & F.col("d.type").isin(*PREFERENCE) & F.col("d.id").isNotNull()
    return rows.select(*keys, entry).where(ok).select(
        *keys, "ordinal", "d.backend", "d.id", F.coalesce("d.name", F.lit("")).alias("name"), F.coalesce("d.vendor", F.lit("")).alias("vendor"), "d.type",
        F.coalesce("d.computeUnits", F.lit(1)).alias("units"), F.coalesce("d.memory", F.lit(1).cast("long")).alias("memory"),
    )


def to_wire(devices: DataFrame, *by: str) -> DataFrame:
    """The JSON array of devices, in order of ``ordinal``."""
    entry = F.struct("ordinal", F.struct("backend", "id", "name", "vendor", "type", F.col("units").alias("computeUnits"), "memory").alias("d"))
    return devices.groupBy(*by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["d"])).alias("devices"))


def classify(kind: Column, unified: Column, vendor: Column) -> Column:
    """The type of an enumerated device: its kind (CPU, GPU, ACCELERATOR), whether memory is shared, and its vendor."""
    v = F.lower(F.coalesce(vendor, F.lit("")))
    shared = F.when(v.contains("amd") | v.contains("advanced micro"), "APU").otherwise("INTEGRATED_GPU")
    return F.when(kind == "GPU", F.when(unified, shared).otherwise("DISCRETE_GPU")).when(kind == "ACCELERATOR", "FPGA").when(kind == "CPU", "CPU").otherwise("OTHER")


class Registry:
    """Backends by name, in the order of their registration: each gives its devices, or says why it has none.

    A backend is a function without arguments that returns a DataFrame of devices, or None if its driver isn't there. It
    may raise: that makes it unavailable and is its reason. Nothing here raises for a backend's sake.
    """

    def __init__(self) -> None:
        self._probes: dict[str, Callable[[], DataFrame | None]] = {}
        self._found: dict[str, tuple[DataFrame | None, str | None]] = {}

    def register(self, name: str, probe: Callable[[], DataFrame | None]) -> None:
        """Add a backend, or replace the one of this name."""
        self._probes[name] = probe
        self._found.pop(name, None)

    def _ask(self, name: str) -> tuple[DataFrame | None, str | None]:
        """A backend is asked once; its first device is computed here, so that a failure shows here too."""
        if name not in self._found:
            try:
                found = self._probes[name]()
                if found is None:
                    self._found[name] = None, f"{name.lower()}: no driver is probed"
                elif not found.limit(1).collect():
                    self._found[name] = None, f"{name} has no devices"
                else:
                    self._found[name] = found, None
            except Exception as e:  # a misbehaving backend mustn't stop the others
                self._found[name] = None, f"{name} failed: {e}"
        return self._found[name]

    def backends(self, spark: SparkSession) -> DataFrame:
        """backend, ordinal, available, reason of every registered backend."""
        rows = [(name, i, self._ask(name)[1] is None, self._ask(name)[1]) for i, name in enumerate(self._probes)]
        return spark.createDataFrame(rows, "backend string, ordinal int, available boolean, reason string")

    def devices(self, spark: SparkSession) -> DataFrame:
        """The devices of all available backends, with the backend's name as ``registered``."""
        out = spark.createDataFrame([], "ordinal long, backend string, id string, name string, vendor string, type string, units int, memory long, registered string")
        for name in self._probes:
            found, _ = self._ask(name)
            if found is not None:
                out = out.unionByName(found.withColumn("registered", F.lit(name)))
        return out


def local(spark: SparkSession, cores: int | None = None, memory: int | None = None) -> DataFrame:
    """The devices of this build on the session's own machine: its processor, as the one device of the CPU backend."""
    cores = cores or spark.sparkContext.defaultParallelism
    row = (0, "JAVA_CPU", "cpu:0", "CPU", "Unknown vendor", "CPU", cores, memory or 1)
    return spark.createDataFrame([row], "ordinal long, backend string, id string, name string, vendor string, type string, units int, memory long")


#: Why a backend can't be used where its driver isn't there, by operating system (fixed values of this build).
REASONS = {"METAL": ("mac", "Metal needs macOS"), "ROCM": ("linux", "ROCm needs Linux")}


def unavailable_reason(backend: Column, os: Column) -> Column:
    """Why a backend of this build can't run kernels: only the CPU path exists, whatever the operating system."""
    reason = F.when(backend == "JAVA_CPU", F.lit(None).cast("string"))
    for name, (needs, text) in REASONS.items():
        reason = reason.when((backend == name) & ~F.lower(os).contains(needs), text)
    return reason.otherwise(F.concat(F.lower(backend), F.lit(": no driver is probed")))
