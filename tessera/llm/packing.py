"""Best-fit packing of documents into sequences by large-item matching.

Every document is cut into pieces of at most ``capacity`` tokens. The packing depends on the piece lengths alone, so the
plan is made from the histogram of lengths (``capacity`` counts, whatever the number of documents) and holds runs of
equal bins. Pieces above one third of the capacity go at most two to a bin, the longest with the longest partner that
fits (greedy matching); shorter pieces go, longest first, into the smallest gap that holds them. Each piece then finds
its bin from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import fresh, slices, stored, with_fields

CAPACITY = 2048
END_ID = 0
#: Salts of a length, and the pieces of a length for which it gets one more.
SALTS, SALT_ROWS = 64, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    start = 0
    while start < n:
        length = first if start == 0 else capacity
        yield start, length
        start += length


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document's ids (null text: empty) with ``end_id`` appended, and each piece's crc32, for each
    row of docs (doc_id, text; more columns are ignored)."""
    path = path or tokens.byte_bpe()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(it):
        encode = tokens.encoder(path).encode
        tail = np.array([end_id], "<u4").tobytes()
        for batch in slices(it):
            out: list[list] = [[] for _ in names]
            for doc, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()])):
                ids = memoryview(ids + tail)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Segments (length, first rank, pieces, first bin, pieces a bin, offset) that place all counted pieces."""
    left = {k: v for k, v in counts.items() if v}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError(f"piece lengths must be between 1 and {capacity}")
    done = dict.fromkeys(left, 0)
    segments: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    bins = 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        segments.append((length, done[length], n, first, each, offset))
        done[length] += n
        left[length] -= n

    def gap(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            fit = bisect_left(large, min(capacity - length, length) + 1) - 1
            while fit >= 0 and not left[large[fit]]:
                fit -= 1
            other = large[fit] if fit >= 0 else 0
            n = left[length] // 2 if other == length else min(left[length], left.get(other, 0))
            if n == 0:
                if other == length and fit > 0:  # a single one of this length: its partner is a shorter one
                    fit = next((i for i in range(fit - 1, -1, -1) if left[large[i]]), -1)
                    other = large[fit] if fit >= 0 else 0
                    n = min(left[length], left.get(other, 0)) if other else 0
                else:
                    other = 0
            if other and n:
                put(length, n, bins, 1, 0)
                put(other, n, bins, 1, length)
                gap(capacity - length - other, bins, n)
            else:
                n = left[length]
                put(length, n, bins, 1, 0)
                gap(capacity - length, bins, n)
            bins += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                n = max(left[length] // each, 1)
                gap(capacity, bins, n)
                bins += n
                continue
            size = sizes[at]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[at]
            each = min(size // length, left[length])
            used = min(n, left[length] // each)
            put(length, used * each, first, each, capacity - size)
            gap(size - each * length, first, used)
            gap(size, first + used, n - used)
    return np.array(sorted(segments), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Add sequence_id and offset to pieces (columns doc_id, piece, length); columns of these names are replaced, all
    others stay.

    Ranks are counted within (length, salt) and shifted by the counts of the salts before. A length has ``salts`` salts
    and one more for every ``salt_rows`` pieces, so that one which most pieces have is ranked by many tasks. Only the
    counts of lengths and salts come to the driver (capacity * salts, and one more for every salt_rows pieces), and only
    they and the plan, which has some segments for each length, go to the executors. Pieces without a doc_id take part;
    repeated rows are placed each. An empty table gives an empty one; lengths that are null, below 1 or above the
    capacity are an error.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select([f"`{c}`" for c in names])
    salt_name, rank_name = fresh(names, "_salt", "_rank")
    sizes = {n: c for n, c in pieces.groupBy("length").count().collect()}
    if any(n is None or not 0 < n <= capacity for n in sizes):
        raise ValueError(f"piece lengths must be between 1 and {capacity}")
    width = np.zeros(capacity + 2, np.int64)
    for n, c in sizes.items():
        width[n] = salts + c // salt_rows
    base = np.cumsum(width) - width
    width_of = F.element_at(F.lit(width[1:].tolist()), F.col("length").cast("int"))
    salted = pieces.withColumn(salt_name, F.pmod(F.xxhash64("doc_id", "piece"), width_of).cast("int"))
    counts = np.zeros(int(width.sum()) + 1, np.int64)
    for n, salt, count in salted.groupBy("length", salt_name).count().collect():
        counts[base[n] + salt] = count
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[base], np.append(width[:-1], width[-1] + 1))  # within the length
    segments = plan_bins(sizes, capacity)
    bound = 64 * capacity
    if len(segments) > bound:
        raise ValueError(f"the plan has {len(segments)} segments, more than {bound}")
    length, rank, _, first, each, offset = segments.T
    key = (length << 44) | rank
    own = F.row_number().over(Window.partitionBy("length", salt_name).orderBy("doc_id", "piece")).cast("long")
    ranked = salted.withColumn(rank_name, own - 1)
    length_at = names.index("length")

    def place(it):
        for b in it:
            n, salt, r = (b.column(k).to_numpy() for k in (length_at, len(names), len(names) + 1))
            r = r + before[base[n] + salt]
            s = np.searchsorted(key, (n << 44) | r, "right") - 1
            k = r - rank[s]
            bins, at = first[s] + k // each[s], offset[s] + (k % each[s]) * n
            columns = [*(b.column(k) for k in range(len(names))), pa.array(bins, pa.int64()), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, with_fields(pieces.schema, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise and pack documents (doc_id, text; more columns are ignored). One row for each piece.

    Null text is empty, and an empty document is a piece of the end id alone. A null doc_id stays null; rows that share a
    doc_id are packed each. An empty table gives an empty one.
    """
    return pack(stored(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)
