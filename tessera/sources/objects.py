"""Named objects: datasets addressed by name and instance, with checksums, awaiting, and keyed array elements."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the
    session is a local one. On a cluster it has to be set, or the files of one machine would be missed elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-objects-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written into the shared folder and read again: a cut of the lineage that survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class ObjectStore:
    """Datasets below a folder. Publishing again replaces an instance.

    An instance is its data files and, written after them, a manifest of their sizes and checksums: who receives it waits
    for the manifest and compares. An object without a name gets the next running number.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._unnamed = spark, folder.rstrip("/"), 0

    def path(self, name: str, instance: int) -> str:
        return f"{self.folder}/name={name}/instance={instance}"

    def _manifest_path(self, name: str, instance: int) -> str:
        return f"{self.folder}/_manifests/name={name}/instance={instance}"

    def publish(self, df: DataFrame, name: str | None = None, instance: int = 0) -> str:
        """Write an object and its manifest; gives its path."""
        if name is None:
            name, self._unnamed = f"object-{self._unnamed}", self._unnamed + 1
        path, manifest = self.path(name, instance), self._manifest_path(name, instance)
        files = StructType.fromDDL(MANIFEST)
        self.spark.createDataFrame([], files).write.mode("overwrite").json(manifest)  # what was there is no longer whole
        df.write.mode("overwrite").option("compression", "gzip").parquet(path)
        file_checksums(self.spark, path).write.mode("overwrite").json(manifest)
        return path

    def resolve(self, name: str, instance: int = 0) -> DataFrame:
        """A missing object raises AnalysisException."""
        return self.spark.read.parquet(self.path(name, instance))

    def receive(self, name: str, instance: int = 0, sleep: float = 0.5, tries: int = 600) -> DataFrame:
        """Wait for an object that somebody else publishes, until its files agree with its manifest. TimeoutError after so
        many tries; ValueError if it is there but its checksums differ."""
        differs = False
        for k in range(max(tries, 1)):
            try:
                wanted = self.spark.read.schema(MANIFEST).json(self._manifest_path(name, instance))
                found = file_checksums(self.spark, self.path(name, instance))
                n = wanted.count()
                differs = n > 0 and (found.count() != n or wanted.exceptAll(found).limit(1).count() > 0)
                if n and not differs:
                    return self.resolve(name, instance)
            except AnalysisException:
                pass
            if k + 1 < tries:
                time.sleep(sleep)
        if differs:
            raise ValueError(f"the files of {name} instance {instance} differ from their checksums")
        raise TimeoutError(f"{name} instance {instance} hasn't come after {tries} tries")

    def manifest(self, pattern: str = "*") -> DataFrame:
        """path, size and SHA-1 of every data file of all objects whose name fits the pattern."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(f"{self.folder}/name=*")
        return files.select("path", F.col("length").alias("n_bytes"), F.sha1("content").alias("checksum"))


MANIFEST = "file string, n_bytes long, checksum string"


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-1 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("n_bytes"), F.sha1("content").alias("checksum"))


def checksums(df: DataFrame, key: str, content: str) -> DataFrame:
    return df.select(key, F.sha1(F.col(content).cast("binary")).alias("checksum"))


def deduplicate(df: DataFrame, key: str, content: str) -> DataFrame:
    """One key for each distinct content (the least), and how many have it."""
    return df.groupBy(F.sha1(F.col(content).cast("binary")).alias("checksum")).agg(F.min(key).alias(key), F.count("*").alias("n_copies"))


def last_write(updates: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value of each key that was written last, of equal orders the greatest value; one aggregate, no sort."""
    return updates.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias(value), F.max(order).alias(order))


def element(elements: DataFrame, object_name: str, position: str, instance: int) -> DataFrame:
    return elements.where((F.col("object") == object_name) & (F.col("position") == position) & (F.col("instance") == instance))


def update_values(values: DataFrame, updates: DataFrame) -> DataFrame:
    """values (id, name, value, further columns) with the values of updates (id, value) where there are any."""
    new = updates.select("id", F.col("value").alias("_new"))
    rest = [c for c in values.columns if c not in ("id", "name", "value")]
    return values.join(new, "id", "left").select("id", "name", F.coalesce("_new", "value").alias("value"), *rest)


def resolve_names(values: DataFrame, expressions: DataFrame, *by: str) -> DataFrame:
    """Replace names by the right sides of expressions (ordinal, string, right).

    A name is looked up without regard to case, in the order of the expressions; the first match counts. Then every
    match of a call (the columns ``by`` of values; without any, all values are one call) is replaced in all names of the
    call, in order of the ids, as a fold over the list of matches: a few arguments of the call.
    """
    first = expressions.groupBy(F.lower("string").alias("_key")).agg(F.min_by("right", "ordinal").alias("to"))
    matched = values.join(first, F.lower("name") == F.col("_key")).select(*by, "id", F.col("name").alias("from"), "to")
    fold = matched.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", "from", "to"))).alias("steps"))
    step = lambda acc, s: F.replace(acc, s["from"], s["to"])
    calls = values.join(fold, list(by), "left") if by else values.withColumn("steps", fold.scalar())
    name = F.when(F.col("steps").isNull(), F.col("name")).otherwise(F.aggregate("steps", F.col("name"), step))
    return calls.select(*by, "id", name.alias("name"), "value")


def first_hit(df: DataFrame, condition: str, *order: str) -> DataFrame:
    """The first row (in order) that meets a condition; a scan keeps one row a partition."""
    return df.where(condition).orderBy(*order).limit(1)


def append_elements(elements: DataFrame, path: str) -> None:
    """Append keyed elements (object, instance, position, value, seq); readers take the last write of each key."""
    elements.select("object", "instance", "position", "value", "seq").write.mode("append").parquet(path)


def random_values(spark: SparkSession, n: int, seed: int, partitions: int | None = None) -> DataFrame:
    """n pseudo-random integers that depend on the seed alone."""
    return spark.range(0, n, 1, partitions).select("id", F.expr(f"cast(pmod(xxhash64(id, {seed}), 2147483647) as int)").alias("value"))
