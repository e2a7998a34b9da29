"""Fuzzy line deduplication by MinHash.

A line is a text's part between line ends, without ASCII white space at its ends; blank lines take no part. Equal lines
are one class (by a 64-bit hash of the line). A class gets a MinHash signature of its character shingles and meets
others in bands of it; pairs in a band are compared exactly by the Jaccard similarity of their shingles, and the links
become components by distributed union-find. Of each component the line that comes first (smallest doc_id, then line
number) stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh, mix, slices, span_hashes, stored, utf8, with_fields
from .jaccard import BLOCK, HOT, leaders, link_groups

#: Characters in a shingle; a shorter line is one shingle.
SHINGLE = 8
#: Similar lines: NUM/DEN or more. With 32 hashes in 12 bands of 4 (some hashes are in two bands), simulated with ideal
#: hashes, a pair at 0.8 meets with probability 0.994, at 0.85 with 0.999.
NUM, DEN = 80, 100
HASHES, BANDS, ROWS = 32, 12, 4
_random = np.random.Generator(np.random.PCG64(77))
_FACTORS = _random.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
#: The hashes of each band: every hash is in one or two.
_BAND = np.concatenate([_random.permutation(HASHES), _random.permutation(HASHES)])[: BANDS * ROWS].reshape(BANDS, ROWS)
_A32 = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_A = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Characters that are worked on at once.
CHUNK = 1 << 17


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number (from 0 in its row) of every line that isn't blank, without white space at its ends."""
    n = len(off) - 1
    ends = np.flatnonzero(data == 10)
    start = np.concatenate([off[:-1], ends + 1])
    row = np.concatenate([np.arange(n), np.searchsorted(off, ends, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.concatenate([start[1:] - 1, [0]])
    last = np.append(row[1:] != row[:-1], True)
    end[last] = off[row[last] + 1]
    number = np.arange(len(start)) - np.searchsorted(row, row)
    solid = np.flatnonzero(~ASCII_SPACE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    keep = b > a
    a, b = a[keep], b[keep]
    return solid[a], solid[b - 1] + 1, row[keep], number[keep]


def char_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit-mixed 64-bit hashes of the SHINGLE-character shingles of each line, and the n + 1 offsets of the lines."""
    size = np.array([len(x) for x in lines], np.int64)
    c = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    base = np.concatenate([[0], np.cumsum(size)])
    x, step = c + np.uint64(0x9E3779B9), 1
    for factor in _A:  # 1, 2, 4, then 8 characters
        y = x * factor
        y[: max(len(x) - step, 0)] += x[step:]
        x, step = y ^ (y >> np.uint64(29)), 2 * step
    x = mix(x)
    count = np.maximum(size - SHINGLE + 1, 1)
    off = np.concatenate([[0], np.cumsum(count)])
    out = x[np.arange(off[-1]) + np.repeat(base[:-1] - off[:-1], count)] if len(c) else np.zeros(off[-1], np.uint64)
    for k in np.flatnonzero(size < SHINGLE):  # what follows such a line mustn't matter
        out[off[k]] = np.uint64(hash(tuple(c[base[k] : base[k + 1]].tolist())) & (1 << 64) - 1)
    return out, off


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    h, off = char_shingles(lines)
    return [np.unique(h[a:b]) for a, b in zip(off, off[1:])]


def bands(lines: list[str]) -> np.ndarray:
    """One hash for each line and band. Lines have SHINGLE characters at least.

    Shingles are hashed to 32 bits here; where a line ends, the places without a whole shingle repeat its first one.
    """
    if not lines:
        return np.zeros((0, BANDS), np.uint64)
    size = np.array([len(x) for x in lines], np.int64)
    end = np.cumsum(size)
    x = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32) + np.uint32(0x9E3779B9)
    for step, factor in zip((1, 2, 4), _A32):  # 2, 4, then 8 characters
        y = x * factor
        y[:-step] += x[step:]
        x = y ^ (y >> np.uint32(15))
    for factor, shift in zip((0x85EBCA6B, 0xC2B2AE35), (13, 16)):
        x *= np.uint32(factor)
        x ^= x >> np.uint32(shift)
    x[end[:, None] - np.arange(1, SHINGLE)] = x[end - size][:, None]
    least, buffer = np.empty((len(lines), HASHES), np.uint32), np.empty_like(x)
    for k in range(HASHES):
        np.bitwise_xor(x, _SALTS[k], out=buffer)
        np.multiply(buffer, _FACTORS[k], out=buffer)
        least[:, k] = np.minimum.reduceat(buffer, end - size)
    out = np.empty((len(lines), BANDS), np.uint64)
    for b, of in enumerate(_BAND):
        x = np.full(len(lines), b + 1, np.uint64)
        for k in of:
            x = mix(x * _A[0] + least[:, k])
        out[:, b] = x
    return out


def _chunks(size: np.ndarray):
    """Ranges of lines with about CHUNK characters each."""
    at = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(size):
        b = max(int(np.searchsorted(at, at[a] + CHUNK, "right")) - 1, a + 1)
        yield a, b
        a = b


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), id (hash) and tokens (one for each band) of all lines that aren't blank.

    A task gives a line that it has seen lately without its tokens (null). Lines of fewer than SHINGLE characters are
    similar to equal ones alone and have none.
    """

    def run(it):
        seen: set[int] = set()
        for batch in slices(it):
            data, off = utf8(batch.column(1))
            start, end, row, number = line_spans(data, off)
            ids = span_hashes(data, start, end).view(np.int64)
            _, first = np.unique(ids, return_index=True)
            first = [k for k in np.sort(first).tolist() if int(ids[k]) not in seen]
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(ids[first].tolist())
            raw = data.tobytes()
            lines = [raw[start[k] : end[k]].decode() for k in first]
            long = [k for k, x in enumerate(lines) if len(x) >= SHINGLE]
            lines, banded = [lines[k] for k in long], np.array(first, np.int64)[np.array(long, np.int64)]
            parts = [bands(lines[a:b]) for a, b in _chunks(np.array([len(x) for x in lines], np.int64))]
            tokens = np.concatenate(parts).view(np.int64) if parts else np.zeros((0, BANDS), np.int64)
            has = np.zeros(len(ids), bool)
            has[banded] = True
            at = np.cumsum(has) - has
            doc = batch.column(0).take(pa.array(row))
            for a in range(0, len(ids), 10_000):
                own = has[a : a + 10_000]
                off = np.concatenate([[0], np.cumsum(own) * BANDS]).astype(np.int32)
                of = tokens[at[a] : at[a] + off[-1] // BANDS]
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(of.ravel()), mask=pa.array(~own))
                yield pa.RecordBatch.from_arrays([doc[a : a + 10_000], pa.array(number[a : a + 10_000], pa.int32()), pa.array(ids[a : a + 10_000]), lists], names=["doc_id", "line", "id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line int, id long, tokens array<long>")


def kept_lines(docs: DataFrame, num: int = NUM, den: int = DEN, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, keep (sorted numbers of the lines that stay) for every document that keeps a line that isn't blank."""
    named = docs.where("doc_id is not null")
    lines = stored(line_table(named), "lines")
    classes = stored(lines.groupBy("id").agg(F.min(F.struct("doc_id", "line")).alias("first")), "classes")
    pairs = stored(leaders(lines.where("tokens is not null").select("id", "tokens"), hot=hot), "pairs")
    texts = named.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = pairs.select("rep").distinct().join(classes, F.col("rep") == classes.id).select("first.doc_id", F.struct("first.line", "rep").alias("want"))
    joined = texts.join(wanted.groupBy("doc_id").agg(F.collect_list("want").alias("wants")), "doc_id").select("text", "wants")

    def cut(it):
        for batch in slices(it):
            lines = []
            for text, wants in zip(*(c.to_pylist() for c in batch.columns)):
                parts = text.split("\n") if text else []
                lines += [(parts[w["line"]].strip(" \t\n\r\v\f"), w["rep"]) for w in wants if w["line"] < len(parts)]
            data, off = utf8(pa.array([x for x, _ in lines], pa.string()))
            # another text of the same doc_id has other lines at these numbers
            own = np.array([rep for _, rep in lines], np.int64)
            right = pa.array(span_hashes(data, off[:-1], off[1:]).view(np.int64) == own)
            yield pa.RecordBatch.from_arrays([pa.array(own).filter(right), pa.array([x for x, _ in lines], pa.string()).filter(right)], names=["rep", "payload"])

    payloads = stored(joined.mapInArrow(cut, "rep long, payload string"), "payloads")
    found = link_groups(pairs, payloads, shingle_sets, num, den, block)
    of = classes.join(found, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("first").alias("first"))
    return of.groupBy("first.doc_id").agg(F.array_sort(F.collect_list("first.line")).alias("keep"))


def dedup_lines(docs: DataFrame, num: int = NUM, den: int = DEN, block: int = BLOCK, hot: int = HOT, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with text without the lines that repeat an earlier one, and the numbers of lines and of removed lines.

    Both counts leave out blank lines, which all stay. A null text stays null. Rows with a null doc_id stay as they are
    and take no part; rows that share a doc_id keep the same line numbers. Columns named like the counts are replaced.
    """
    docs = docs.select([f"`{c}`" for c in docs.columns if c not in counts])
    names = docs.columns
    text_at = names.index("text")
    key, own = fresh(names, "_id", "_keep")
    keep = kept_lines(docs, num, den, block, hot).select(F.col("doc_id").alias(key), F.col("keep").alias(own))
    joined = docs.join(keep, F.col("doc_id").cast("long") == F.col(key), "left").select(*[f"`{c}`" for c in names], F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.array().cast("array<int>"))).alias(own))

    def run(it):
        for batch in slices(it):
            texts, n, gone = [], [], []
            for text, keep in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist()):
                lines = text.split("\n") if text else []
                solid = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\v\f")]
                n.append(len(solid))
                drop = set(solid).difference(keep) if keep is not None else ()
                gone.append(len(drop))
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else text)
            arrays = [batch.column(i) if i != text_at else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int32()), pa.array(gone, pa.int32())], names=[*names, *counts])

    return joined.mapInArrow(run, with_fields(docs.schema, f"{counts[0]} int, {counts[1]} int"))


def keep_fresh(docs: DataFrame) -> DataFrame:
    """Pipeline stage: docs without repeated lines; a document all of whose lines repeat earlier ones goes.

    Documents that had no line (null, empty or blank texts) and those with a null doc_id stay.
    """
    n, gone = fresh(docs.columns, "_n_lines", "_n_removed")
    found = dedup_lines(docs, counts=(n, gone))
    return found.where((F.col(n) == 0) | (F.col(gone) < F.col(n))).select([f"`{c}`" for c in docs.columns])
