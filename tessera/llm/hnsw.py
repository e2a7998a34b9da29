"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node that carries its smallest ids. Nodes are dealt to cells by their nearest pivot, and the nodes
of a cell to shards of a bounded size by a hash; each shard's graph is a few flat arrays (vectors, neighbours of each
level). A query goes through the shards of its nearest cells, in blocks of queries, and the shards' results are merged.
How many cells are enough is measured on the data: where vectors have no structure, that is nearly all. Vectors get one
more component that gives all nodes of a shard the same length, so that the largest inner product is the nearest node.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, with_fields

SHARD = 8192
#: Queries that a task takes through a shard at once.
BLOCK = 1 << 16
#: Shards whose results for a query are merged at once.
MERGE = 64
#: Cells at most; queries that measure how many cells are needed; the share of what they find that has to lie in those.
CELLS, SAMPLE, PROBED = 4096, 256, 0.995
M, EF_BUILD, EF_SEARCH = 16, 80, 120


class Graph:
    """The graph of one shard. Level 0 has up to 2 M neighbours, higher levels M; -1 marks free places."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD) -> None:
        v = vectors.astype(np.float32)
        norm = np.einsum("ij,ij->i", v, v)
        top = norm.max(initial=0)
        self.v = np.concatenate([v, np.sqrt(np.maximum(top - norm, 0))[:, None]], 1).astype(np.float32)
        n = len(v)
        level = (-np.log(np.random.default_rng(n).random(n).clip(1e-12)) / np.log(m)).astype(int)
        self.levels = int(level.max(initial=0)) + 1
        slack = m // 2  # a list may run over by this before it is pruned
        self.width = [2 * m] + [m] * (self.levels - 1)
        self.near = [np.full((n, w + slack), -1, np.int32) for w in self.width]
        self.degree = [np.zeros(n, np.int32) for _ in self.width]
        self.stamp, self.time = np.zeros(n, np.int64), 0
        self.entry, self.top = -1, -1
        for i in range(n):
            self._insert(i, int(level[i]), m, ef)

    def _walk(self, q: np.ndarray, start: list[tuple[float, int]], level: int, ef: int) -> list[tuple[float, int]]:
        """The ef nodes found nearest to q on a level: (inner product, node), in no order."""
        self.time += 1
        time, stamp, near, degree, v = self.time, self.stamp, self.near[level], self.degree[level], self.v
        for _, i in start:
            stamp[i] = time
        best = list(start)
        heapq.heapify(best)
        todo = [(-s, i) for s, i in start]
        heapq.heapify(todo)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            ids = near[i, : degree[i]]
            ids = ids[stamp[ids] != time]
            if not len(ids):
                continue
            stamp[ids] = time
            scores = v[ids] @ q
            if len(best) >= ef:
                ok = scores > best[0][0]
                ids, scores = ids[ok], scores[ok]
            for s, j in zip(scores.tolist(), ids.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                else:
                    continue
                heapq.heappush(todo, (-s, j))
        return best

    def _select(self, scores: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
        """Up to m of the ids, nearest first, each nearer to the node than to those chosen before; then the nearest."""
        order = np.argsort(-scores, kind="stable")
        ids, scores = ids[order], scores[order]
        if len(ids) <= m // 2:
            return ids
        x = self.v[ids]
        between = x @ x.T
        free, chosen = np.ones(len(ids), bool), []
        at = 0
        while len(chosen) < m and at < len(ids):
            chosen.append(at)
            free[at] = False
            free &= between[at] < scores
            rest = np.flatnonzero(free[at + 1 :])
            if not len(rest):
                break
            at += 1 + int(rest[0])
        if len(chosen) < m // 2:
            more = np.setdiff1d(np.arange(len(ids)), chosen)[: m // 2 - len(chosen)]
            chosen = [*chosen, *more]
        return ids[chosen]

    def _insert(self, i: int, level: int, m: int, ef: int) -> None:
        q = self.v[i]
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for l in range(self.top, level, -1):
            at = [max(self._walk(q, at, l, 1))]
        for l in range(min(level, self.top), -1, -1):
            at = self._walk(q, at, l, ef)
            scores, ids = np.array([s for s, _ in at], np.float32), np.array([j for _, j in at], np.int32)
            own = self._select(scores, ids, m)
            self.near[l][i, : len(own)] = own
            self.degree[l][i] = len(own)
            near, degree = self.near[l], self.degree[l]
            for j in own.tolist():
                near[j, degree[j]] = i
                degree[j] += 1
                if degree[j] == near.shape[1]:
                    kept = self._select(self.v[near[j]] @ self.v[j], near[j].copy(), self.width[l])
                    near[j] = -1
                    near[j, : len(kept)] = kept
                    degree[j] = len(kept)
        if level > self.top:
            self.entry, self.top = i, level

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """The nodes found nearest to q, at most max(k, ef), in no order."""
        if self.entry < 0:
            return np.zeros(0, np.int64)
        q = np.append(q, 0).astype(np.float32)
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for l in range(self.top, 0, -1):
            at = [max(self._walk(q, at, l, 1))]
        return np.array([j for _, j in self._walk(q, at, 0, max(k, ef))], np.int64)

    def to_bytes(self) -> bytes:
        """The flat arrays, as one value of the index table. Higher levels keep only the nodes that they have."""
        arrays = {"v": self.v, "head": np.array([self.entry, self.top, self.levels])}
        for l, (near, degree) in enumerate(zip(self.near, self.degree)):
            has = np.arange(len(near)) if l == 0 else np.flatnonzero(degree)
            arrays |= {f"has{l}": has.astype(np.int32), f"near{l}": near[has], f"degree{l}": degree[has]}
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        x, g = np.load(io.BytesIO(data)), cls.__new__(cls)
        g.v = x["v"]
        g.entry, g.top, g.levels = map(int, x["head"])
        g.near, g.degree = [], []
        for l in range(g.levels):
            near, degree = np.full((len(g.v), x[f"near{l}"].shape[1]), -1, np.int32), np.zeros(len(g.v), np.int32)
            near[x[f"has{l}"]], degree[x[f"has{l}"]] = x[f"near{l}"], x[f"degree{l}"]
            g.near.append(near)
            g.degree.append(degree)
        g.stamp, g.time = np.zeros(len(g.v), np.int64), 0
        return g


def _precision(rows: DataFrame) -> type:
    """The type of a vector's components: float for a column of float, double for any other."""
    return np.float32 if rows.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (array of float or double, zeros without a sign) of the rows that take part."""
    name = "float" if _precision(rows) is np.float32 else "double"
    rows = rows.select("vec_id", F.col("embedding").cast(f"array<{name}>").alias("embedding"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(ok & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x + F.lit(0.0).cast(name)).alias("vector"))


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids (all that a result of k can hold besides the query's own).

    Each partition first keeps the smallest ids of its own vectors, so a vector that many rows have isn't gathered.
    """

    kind = _precision(rows)
    width = np.dtype(kind).itemsize

    def partial(it):
        found: dict[bytes, list[int]] = {}

        def table():
            keys = list(found)
            at = np.cumsum([0, *(len(x) // width for x in keys)])
            vectors = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(keys), kind)))
            return pa.RecordBatch.from_arrays([vectors, pa.array(found.values(), pa.list_(pa.int64()))], names=["vector", "ids"])

        for batch in it:
            column = batch.column(1)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy().astype(kind)
            for i, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                ids = found.setdefault(flat[a:b].tobytes(), [])
                if len(ids) <= k or i < ids[-1]:
                    if i not in ids:
                        ids.append(i)
                        ids.sort()
                        del ids[k + 1 :]
            if len(found) >= 20_000:
                yield table()
                found.clear()
        if found:
            yield table()

    merged = _usable(rows).mapInArrow(partial, f"vector array<{'float' if width == 4 else 'double'}>, ids array<long>").groupBy("vector")
    return merged.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


@dataclass
class Cells:
    """Where vectors and queries go: pivots of each dimension, and the shards of each cell.

    A vector's cell is that of the pivot nearest to it once all vectors have been given one length, as in a graph. Cells
    of more than shard_rows vectors have several shards. Dimensions without a pivot have one cell.
    """

    pivots: dict[int, np.ndarray]  # of length CELLS at most in all
    longest: float
    shards: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)  # (dim, cell): first shard and how many

    def _lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        own = self.pivots.get(x.shape[1])
        return np.zeros(len(x), np.int64) if own is None else (self._lift(x) @ self._lift(own).T).argmax(1)

    def of_queries(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n cells whose pivots have the largest inner products with each query, the largest first."""
        own = self.pivots.get(q.shape[1])
        return np.zeros((len(q), 1), np.int64) if own is None else np.argsort(-(q @ own.T), axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch, dim: int):
    """The rows of a batch by vector length (column ``dim``): length and rows."""
    n = batch.column(dim).to_numpy()
    for d in np.unique(n):
        yield int(d), batch.filter(pa.array(n == d))


def fit_cells(found: DataFrame, cells: int) -> Cells:
    """Pivots: the vectors of the least hashes. At most CELLS of them come to the driver, whatever the number of rows."""
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    longest = found.agg(F.max(square)).first()[0] or 0.0
    own: dict[int, list[list[float]]] = {}
    for (vector,) in found.select("vector").orderBy(F.xxhash64("vector", F.lit(1)), "vector").limit(cells).collect() if cells > 1 else []:
        own.setdefault(len(vector), []).append(vector)
    return Cells({d: np.array(v, np.float64) for d, v in own.items()}, float(np.sqrt(longest)))


def build_index(rows: DataFrame, k: int = 20, shard_rows: int = SHARD, most_cells: int = CELLS) -> tuple[DataFrame, Cells]:
    """The index table: shard, dim, graph (bytes), vectors, ids (of the nodes) for every shard of up to about shard_rows
    nodes; and the cells that the shards belong to."""
    found = stored(nodes(rows, k), "hnsw-nodes")
    kind = _precision(rows)
    cells = fit_cells(found, min(most_cells, -(-found.count() // shard_rows)))

    def place(it):
        for batch in slices(it):
            for _, part in _by_dim(batch, 2):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.of_vectors(_matrix(part.column(0))).astype(np.int32))], names=["vector", "ids", "dim", "cell"])

    with_dim = found.withColumn("dim", F.size("vector"))
    held = stored(with_dim.mapInArrow(place, with_fields(with_dim.schema, "cell int")), "hnsw-cells")
    shards = 0
    for dim, cell, n in sorted(held.groupBy("dim", "cell").count().collect()):
        cells.shards[dim, cell] = shards, -(-n // shard_rows)
        shards += -(-n // shard_rows)
    numbers = rows.sparkSession.createDataFrame([(d, c, a, n) for (d, c), (a, n) in cells.shards.items()], "dim int, cell int, first int, parts int")
    # one row for each cell: CELLS and the number of dimensions bound it
    dealt = held.join(F.broadcast(numbers), ["dim", "cell"]).select((F.col("first") + F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")).alias("shard"), "dim", "vector", "ids")

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
        order = np.argsort([i[0] for i in table.column("ids").to_pylist()], kind="stable")
        ids = [table.column("ids")[int(i)].as_py() for i in order]
        graph = Graph(flat[order]).to_bytes()
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "graph": pa.array([graph], pa.binary()), "vectors": pa.array([flat[order].tobytes()], pa.binary()), "ids": pa.array([ids], pa.list_(pa.list_(pa.int64())))})

    index = stored(dealt.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, graph binary, vectors binary, ids array<array<long>>"), "hnsw-index")
    return index, cells


def _asked(queries: DataFrame, cells: Cells, probes: int, blocks: int) -> DataFrame:
    """Each query once for every shard of its ``probes`` cells: vec_id, vector, dim, block, shard, place (of the cell among
    the query's, from 0)."""
    rows = queries.select("vec_id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    names = rows.columns

    def route(it):
        for batch in slices(it):
            for dim, part in _by_dim(batch, 2):
                chosen = cells.of_queries(_matrix(part.column(1)), probes)
                at, shard, place = [], [], []
                for i, own in enumerate(chosen.tolist()):
                    for p, cell in enumerate(own):
                        first, n = cells.shards.get((dim, cell), (0, 0))
                        at += [i] * n
                        shard += range(first, first + n)
                        place += [p] * n
                for a in range(0, len(at), 10_000):
                    rest = part.take(pa.array(at[a : a + 10_000], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(shard[a : a + 10_000], pa.int32()), pa.array(place[a : a + 10_000], pa.int32())], names=[*names, "shard", "place"])

    return rows.mapInArrow(route, with_fields(rows.schema, "shard int, place int"))


def _search_shards(index: DataFrame, asked: DataFrame, kinds: tuple[type, type], k: int, ef: int, blocks: int) -> DataFrame:
    """query_id, shard, place, hits (at most k, with negative scores) of every query in every shard that it asks."""

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        own, hits = [], []
        if shard.num_rows and asked.num_rows:
            dim = shard.column("dim")[0].as_py()
            graph, ids = Graph.from_bytes(shard.column("graph")[0].as_py()), shard.column("ids")[0].as_py()
            x = np.frombuffer(shard.column("vectors")[0].as_py(), kinds[0]).reshape(-1, dim).astype(np.float64)
            q = asked.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kinds[1]).reshape(-1, dim)
            own = asked.column("vec_id").to_pylist()
            for i, vector in zip(own, q):
                at = graph.search(vector, k + 1, ef)
                exact = (x[at] * vector.astype(np.float64)).sum(1)
                if len(at) > k + 1:  # the query's own node may hold no other id; nodes with the last score all stay
                    near = exact >= np.partition(exact, len(exact) - k - 1)[len(exact) - k - 1]
                    at, exact = at[near], exact[near]
                found = sorted((-float(s), j) for s, a in zip(exact, at) for j in ids[a] if j != i)[:k]
                hits.append([{"s": s, "vec_id": j} for s, j in found])
        hit = pa.list_(pa.struct([("s", pa.float64()), ("vec_id", pa.int64())]))
        number = shard.column("shard")[0].as_py() if own else 0
        place = asked.column("place") if own else pa.array([], pa.int32())
        return pa.table({"query_id": pa.array(own, pa.int64()), "shard": pa.array([number] * len(own), pa.int32()), "place": place, "hits": pa.array(hits, hit)})

    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["shard", "dim", "block"]
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, shard int, place int, hits array<struct<s:double,vec_id:bigint>>")


def probes_needed(index: DataFrame, cells: Cells, usable: DataFrame, kinds: tuple[type, type], k: int, ef: int) -> int:
    """How many cells a query has to ask: so many that PROBED of what SAMPLE queries find in all cells lies in them."""
    most = max((len(p) for p in cells.pivots.values()), default=1)
    if most == 1:
        return 1
    sample = usable.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id", "vector").limit(SAMPLE)
    found = _search_shards(index, _asked(sample, cells, most, 1), kinds, k, ef, 1).select("query_id", "place", F.explode("hits").alias("hit"))
    nearest = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("hit.s", "hit.vec_id", "place"))), 1, k).alias("best"))
    counts = np.zeros(most, np.int64)
    for place, n in nearest.select(F.explode("best.place").alias("place")).groupBy("place").count().collect():
        counts[place] = n
    return int(np.searchsorted(np.cumsum(counts), PROBED * counts.sum()) + 1) if counts.any() else most


def search(rows: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD, ef: int = EF_SEARCH, block: int = BLOCK, most_cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each query (rows of vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components take no part, and only vectors of a query's own
    length do. Components of integer or double type are searched in single precision too, but scored and told apart in
    double precision. Rows with equal vec_id and vector count once; a query's own row is left out. Ties go to the smaller
    vec_id among all found. An empty table gives an empty result; further columns are ignored.

    A query asks the shards of the cells nearest to it, as many as the data need: a sample of queries asks all. A task has
    one shard's graph and one block of queries at a time; the merge has k candidates of MERGE shards for a query.
    """
    index, cells = build_index(rows, k, shard_rows, most_cells)
    kinds = _precision(rows), _precision(queries)
    usable = _usable(queries).distinct()
    blocks = max(1, -(-usable.count() // block))
    probes = probes_needed(index, cells, usable, kinds, k, ef)
    merged = _search_shards(index, _asked(usable, cells, probes, blocks), kinds, k, ef, blocks).drop("place")
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")
    left = sum(n for _, n in cells.shards.values())
    while left > MERGE:  # at most MERGE lists of k at a time
        merged = merged.groupBy("query_id", F.floor(F.col("shard") / MERGE).cast("int").alias("shard")).agg(nearest)
        left = -(-left // MERGE)
    merged = merged.groupBy("query_id").agg(nearest)
    return merged.select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )
