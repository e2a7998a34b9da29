"""What the operators share: the cluster's shared folder, bounded Arrow batches and text as flat byte arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes that Python works on at once. Texts are long, so Spark's batches would be too much.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the
    session is a local one (tests). On a cluster it has to be set, or the files of one machine would be missed elsewhere.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most BATCH_ROWS rows and BATCH_BYTES bytes; a longer row goes alone.

    Spark bounds what it sends in bytes (spark.sql.execution.arrow.maxBytesPerBatch); numpy work needs many times the
    bytes of its texts, so it is done by slices, whatever the session's settings.
    """
    for batch in batches:
        a = 0
        while a < batch.num_rows:
            part = batch.slice(a, BATCH_ROWS)
            while part.num_rows > 1 and part.nbytes > BATCH_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            a += part.num_rows


def kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet below the shared folder and read it again: cuts the lineage, survives lost executors. Also
    gives its path, for erase()."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """As kept(), for tables that the result still reads; the folder's owner removes them."""
    return kept(df, label)[0]


def erase(spark: SparkSession, *paths: str) -> None:
    """Remove tables of kept() that nothing needs any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that aren't among the taken ones (in any case), for helper columns."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, column: int | str) -> list[str]:
    """A text column as Python strings; null becomes empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def with_fields(schema: StructType, more: str) -> StructType:
    """A schema with further fields, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


# ---- hashes over bytes -------------------------------------------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One 64-bit value for each byte, from a fixed seed, so that all executors agree.
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes hashed at once: bounds the arrays that hashing needs besides the text.
SEGMENT = 1 << 21
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT)
        for name, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end]; spans are ascending and don't overlap.

    A span's hash is a polynomial in its bytes, from prefix sums modulo 2**64; a segment of SEGMENT bytes is worked on
    at a time, a longer span alone.
    """
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        base = start[k]
        to = max(int(np.searchsorted(end, base + SEGMENT, "right")), k + 1)
        s, e = start[k:to] - base, end[k:to] - base
        up, down = _power(int(e[-1]) + 1)
        total = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(_BYTE[data[base : base + int(e[-1])]] * up[: int(e[-1])], out=total[1:])
        out[k:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        k = to
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside ``space`` (256 booleans); rows cut runs."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    first[cut[inside[cut]]] = True
    start = np.flatnonzero(first)
    last = inside[:-1] & ~inside[1:]
    cut = cut[(cut > 0) & (cut < len(data))]
    last[cut[inside[cut - 1]] - 1] = True
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, k: int, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of the k-word shingles, their rows, and the least level of the words of each (levels: one for each word).

    A row with fewer words has one shingle of them all.
    """
    n = np.bincount(row, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    of = np.repeat(np.arange(n_rows), count)
    at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    left = np.minimum(k, n[of] - (at - begin[of]))
    h = np.full(len(of), 0x51ED270B, np.uint64)
    least = None if levels is None else levels[at]
    for i in range(k):
        has = left > i
        word = np.minimum(at + i, max(len(words) - 1, 0))
        part = words[word] if len(words) else h
        h = np.where(has, mix(h * _STEP + part), h)
        if i and least is not None:
            least = np.where(has, np.minimum(least, levels[word]), least)
    return h, of, least
