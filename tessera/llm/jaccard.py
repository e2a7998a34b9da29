"""Exact Jaccard join of documents on word shingles, with signature trees.

Words are runs of characters outside ASCII white space, with A-Z in lower case; a document's set holds the 64-bit hashes
of its shingles. Documents with equal sets are one class, represented by its smallest doc_id.

1. Two sets whose Jaccard similarity reaches the threshold share one of the first tokens of each (prefix filter, under
   any one order of all tokens). The order here puts shingles without a rare word last, as a count sketch of fixed size
   over all words of all documents tells, so that common phrases and passages seldom bring documents together.
2. All classes with a prefix token meet under the token's smallest class, its leader. Every linked pair is in a leader's
   group, and a class is in few groups. A token that very many classes have gets its leader by an aggregate and a join
   instead of in one task. A group of more than BLOCK classes is split into blocks that all hold the leader.
3. A block's task builds a signature tree: classes ordered by size and least token, nodes with OR-combined token bitmaps,
   size ranges and bounds for bitmap collisions. A dual traversal drops the node pairs whose largest possible overlap is
   too small, or whose classes are all linked already; what is left is compared exactly. Only spanning links go out.
4. In a split group, classes outside the leader's component still have to meet the other blocks; they do so in a second
   round. Links become components by distributed union-find.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, LOWER, shingle_hashes, slices, span_hashes, stored, utf8, word_spans
from .components import connected, stars

BLOCK = 1024
#: Postings of a bucket of tokens beyond which its tokens go by a join (a task can hold so many), and the buckets.
HOT, TOKEN_BUCKETS = 2_000_000, 1 << 16
#: Blocks of one row of places.
PLACES = 1024
SKETCH_BITS = 20
SKETCH_PARTS = 64
BITMAP_BYTES = 256
FAN = 8


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of every word."""
    data, off = utf8(column)
    data = LOWER[data]
    start, end, row = word_spans(data, off, ASCII_SPACE)
    return span_hashes(data, start, end), row


def sets_of(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    word, row = words_of(column)
    h, of, _ = shingle_hashes(word, row, len(column), k)
    cut = np.searchsorted(of, np.arange(len(column) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut, cut[1:])]


def prefix_length(n: int, num: int, den: int) -> int:
    """How many first tokens of a set of n one of has to be shared for a similarity of num/den."""
    return n - -(-num * n // den) + 1 if n else 0


def sketch(docs: DataFrame) -> np.ndarray:
    """For each of 2**SKETCH_BITS word buckets, twice the logarithm of how often its words are in all texts."""
    size = 1 << SKETCH_BITS

    def count(it):
        total = np.zeros(size, np.uint32)
        for batch in slices(it):
            word, _ = words_of(batch.column(0))
            total += np.bincount((word >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SKETCH_PARTS)], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size // SKETCH_PARTS, np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    total = np.ones(size)
    for part, counts in rows:
        total[part * size // SKETCH_PARTS : (part + 1) * size // SKETCH_PARTS] = np.frombuffer(counts, np.uint64)
    return (2 * np.log2(np.maximum(total, 1))).astype(np.uint8)


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, digest (two longs) and prefix tokens, in order, of every document.

    The order of all tokens is by the least level of a shingle's words, then by hash.
    """
    levels = sketch(docs)

    def run(it):
        for batch in slices(it):
            word, row = words_of(batch.column(1))
            h, of, level = shingle_hashes(word, row, batch.num_rows, k, levels[(word >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])
            cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
            digests, prefixes, sizes = [], [], []
            for a, b in zip(cut, cut[1:]):
                s, at = np.unique(h[a:b], return_index=True)
                sizes.append(len(s))
                digests.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                key = (level[a:b][at].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                take = prefix_length(len(s), num, den)
                first = np.argpartition(key, take - 1)[:take] if 0 < take < len(s) else np.arange(len(s))
                prefixes.append(s[first[np.argsort(key[first])]].view(np.int64))
            d = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "prefix"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, prefix array<long>")


def leaders(sets: DataFrame, num: int = 0, den: int = 1, hot: int = HOT) -> DataFrame:
    """Distinct (leader, rep) of sets (id, n, tokens in order): for every token of at least two ids, its ids under one of
    them, the leader.

    n is the size of the id's whole set. A token that is the first one that two sets share leaves at most n minus its
    place to share in each; so ids of a token are dealt to separate leaders where sizes leap by more than the threshold
    allows, and ids that can't reach it with any other id of a small group are left out. With num = 0 sizes and places
    don't matter.

    Tokens are counted by bucket first. Those of buckets with more than ``hot`` postings get their leader from an
    aggregate and meet it in a join, whose skew Spark can split; the others, at most ``hot`` of a token, are dealt by
    token and worked on as arrays.
    """
    bucket = F.pmod(F.xxhash64("token"), F.lit(TOKEN_BUCKETS))
    counts = sets.select(F.explode("tokens").alias("token")).groupBy(bucket.alias("bucket")).count()
    heavy = [tuple(r) for r in counts.where(F.col("count") > hot).select("bucket").collect()]  # TOKEN_BUCKETS at most
    postings = sets.select("id", *(["n"] if num else []), F.posexplode("tokens").alias("at", "token"))
    if not heavy:
        return _light_leaders(postings, num, den)
    heavy = sets.sparkSession.createDataFrame(heavy, "bucket long")
    marked = postings.withColumn("bucket", bucket)
    light = _light_leaders(marked.join(F.broadcast(heavy), "bucket", "left_anti"), num, den)
    return light.unionByName(_heavy_leaders(marked.join(F.broadcast(heavy), "bucket", "left_semi"), num, den)).distinct()


def _heavy_leaders(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Under (token, size class): two sets that can reach the threshold have the same or neighbouring classes, and an id
    is in its own class and the next one's."""
    if num:
        step = F.floor(F.log("n") / F.lit(math.log(den / num) * (1 + 1e-9))) if num < den else F.col("n")
        postings = postings.withColumn("size", F.explode(F.array(step, step + 1)))
    else:
        postings = postings.withColumn("size", F.lit(0).cast("long"))
    key = ["token", "size"]
    least = postings.groupBy(*key).agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").drop("last")
    return postings.join(stored(least, "hot-leaders"), key).select("leader", F.col("id").alias("rep")).distinct()


def _light_leaders(postings: DataFrame, num: int, den: int) -> DataFrame:
    dealt = postings.select("id", "token", *(("n", "at") if num else ())).repartition("token")

    def run(it):
        parts = [[c.to_numpy() for c in b.columns] for b in it if b.num_rows]
        if not parts:
            return
        rep, token, *rest = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(token)
        same = token[order[1:]] == token[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)]  # most tokens have one id
        rep, token, rest = rep[order], token[order], [x[order].astype(np.int64) for x in rest]
        order = np.lexsort((rep, rest[0], token) if num else (rep, token))
        rep, token = rep[order], token[order]
        first = np.concatenate([np.ones(min(1, len(token)), bool), token[1:] != token[:-1]])
        if num:
            n, at = (x[order] for x in rest)
            first[1:] |= den * n[:-1] < num * n[1:]
        group = np.cumsum(first) - 1
        size = np.bincount(group)[group] if len(group) else group
        useful = size > (near if num else 1)
        for d in range(1, near if num else 0):  # in groups of up to ``near`` ids all pairs are looked at
            i = np.flatnonzero((group[d:] == group[:-d]) & (size[d:] <= near))
            j = i + d
            most = np.minimum(n[i] - at[i], n[j] - at[j])
            ok = (den + num) * most >= num * (n[i] + n[j])
            useful[i[ok]] = useful[j[ok]] = True
        rep, group = rep[useful], group[useful]
        if not len(rep):
            return
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(starts, len(group)))
        leader = np.repeat(np.minimum.reduceat(rep, starts), size)
        order = np.lexsort((rep, leader))
        leader, rep = leader[order], rep[order]
        new = np.append(True, (leader[1:] != leader[:-1]) | (rep[1:] != rep[:-1]))
        leader, rep = leader[new], rep[new]
        _, times = np.unique(leader, return_counts=True)
        many = np.repeat(times, times) > 1  # not a leader alone with itself
        leader, rep = leader[many], rep[many]
        for a in range(0, len(rep), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(leader[a : a + 10_000]), pa.array(rep[a : a + 10_000])], names=["leader", "rep"])

    near = 16
    return dealt.mapInArrow(run, "leader long, rep long").distinct()


class Forest:
    """Union-find over 0..n-1, with all roots at hand as an array."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def union(self, a: int, b: int) -> bool:
        a, b = self.root[a], self.root[b]
        if a == b:
            return False
        self.root[self.root == max(a, b)] = min(a, b)
        return True


class SignatureTree:
    """Sets with bitmaps, and levels of nodes over FAN children each."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        order = np.lexsort(([s[0] for s in sets], self.size))
        self.order = order
        _, token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        self.token, self.n_tokens = token, int(token.max(initial=-1)) + 1
        self.size = self.size[order]
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        bits = np.zeros((len(order), BITMAP_BYTES * 8), bool)
        width = np.uint64(BITMAP_BYTES * 8)
        spread = np.concatenate([sets[i] for i in order]) % width
        bits[np.repeat(np.arange(len(order)), self.size), spread.astype(np.int64)] = True
        bitmap = np.packbits(bits, axis=1).view(np.uint64)
        extra = self.size - bits.sum(1)
        self.levels = [(bitmap, self.size, self.size, extra)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, e = self.levels[-1]
            cut = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(e, cut)))

    def overlap(self, i: int, js: np.ndarray) -> np.ndarray:
        """Exact sizes of the intersections of set i with the sets js."""
        mark = np.zeros(self.n_tokens, bool)
        mark[self.token[self.at[i] : self.at[i + 1]]] = True
        n = self.size[js]
        ends = np.cumsum(n)
        index = np.arange(ends[-1]) + np.repeat(self.at[js] - (ends - n), n)
        return np.add.reduceat(mark[self.token[index]].astype(np.int64), ends - n)

    def links(self, num: int, den: int, comp: np.ndarray) -> list[tuple[int, int]]:
        """Spanning links (positions in the given sets) between sets that aren't in one component yet."""
        forest, out = Forest(len(self.size)), []
        comp = comp[self.order]
        for c in np.unique(comp[np.flatnonzero(np.bincount(np.unique(comp, return_inverse=True)[1])[np.unique(comp, return_inverse=True)[1]] > 1)]):
            same = np.flatnonzero(comp == c)
            forest.root[same] = same[0]

        def verify(i: int, js: np.ndarray) -> None:
            js = js[forest.root[js] != forest.root[i]]
            if not len(js):
                return
            both = self.overlap(i, js)
            for j in js[den * both >= num * (self.size[i] + self.size[js] - both)].tolist():
                if forest.union(i, j):
                    out.append((int(self.order[i]), int(self.order[j])))

        if len(self.size) > FAN:  # the smallest id first: most of a group is linked to it
            head = int(np.argmin(self.order))
            verify(head, np.flatnonzero(np.arange(len(self.size)) != head))
        self._descend(len(self.levels) - 1, np.zeros(1, int), np.zeros(1, int), num, den, forest, verify)
        return out

    def _descend(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int, forest: Forest, verify) -> None:
        """Go through the node pairs (a, b), a <= b, of a level, some thousand at a time, down to single sets."""
        bitmap, low, high, extra = self.levels[level]
        step = 4096
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            span = FAN**level
            roots = forest.root
            if level:
                starts = np.arange(0, len(roots), span)
                lo, hi = np.minimum.reduceat(roots, starts), np.maximum.reduceat(roots, starts)
            else:
                lo = hi = roots
            open_ = np.maximum(hi[x], hi[y]) != np.minimum(lo[x], lo[y])
            open_ &= (den * high[x] >= num * low[y]) & (den * high[y] >= num * low[x])
            x, y = x[open_], y[open_]
            most = np.bitwise_count(bitmap[x] & bitmap[y]).sum(1, dtype=np.int64) + np.minimum(extra[x], extra[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            ok = (den + num) * most >= num * (low[x] + low[y])
            x, y = x[ok], y[ok]
            if level == 0:
                for i in np.unique(x):
                    verify(int(i), y[(x == i) & (y != i)])
                continue
            n = len(self.levels[level - 1][0])
            child = np.arange(FAN)
            cx = np.repeat(x[:, None] * FAN + child, FAN, axis=1).ravel()
            cy = np.tile(y[:, None] * FAN + child, (1, FAN)).ravel()
            ok = (cx < n) & (cy < n) & (cx <= cy) if level > 1 else (cx < n) & (cy < n) & (cx < cy)
            if ok.any():
                self._descend(level - 1, cx[ok], cy[ok], num, den, forest, verify)


def link_blocks(members: DataFrame, to_sets: Callable[[pa.Array], list[np.ndarray]], num: int, den: int) -> DataFrame:
    """Links (a, b) found in blocks. members: leader, block, rep, comp, payload; to_sets makes sets of payloads.

    A rep may have several sets; it has the links of each.
    """

    def found_in(rows: dict[int, tuple[int, list[np.ndarray]]]) -> list[tuple[int, int]]:
        ids = [i for i in sorted(rows) for _ in rows[i][1]]
        sets = [x for i in sorted(rows) for x in rows[i][1]]
        some = [k for k, x in enumerate(sets) if len(x)]
        comp = np.array([rows[ids[k]][0] for k in some])
        if len(some) > FAN:
            links = SignatureTree([sets[k] for k in some]).links(num, den, comp)
        else:
            links = few_links([sets[k] for k in some], num, den, comp)
        return stars([(ids[some[a]], ids[some[b]]) for a, b in links])

    def traverse(it):
        key, rows = None, {}

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        for batch in slices(it):
            out: list[tuple[int, int]] = []
            sets = to_sets(batch.column(4).to_pylist())
            for leader, block, rep, comp, own in zip(*(c.to_pylist() for c in batch.columns[:4]), sets):
                if (leader, block) != key:
                    out += found_in(rows) if len(rows) > 1 else []
                    key, rows = (leader, block), {}
                of = rows.setdefault(rep, (comp, []))[1]
                if not any(np.array_equal(own, x) for x in of):
                    of.append(own)
            yield table(out)
        yield table(found_in(rows) if len(rows) > 1 else [])

    dealt = members.select("leader", "block", "rep", "comp", "payload").repartition("leader", "block")
    return dealt.sortWithinPartitions("leader", "block").mapInArrow(traverse, "a long, b long").distinct()


def few_links(sets: list[np.ndarray], num: int, den: int, comp: np.ndarray) -> list[tuple[int, int]]:
    """As SignatureTree.links, for as few sets as one node holds."""
    root, out = comp.tolist(), []
    for j in range(1, len(sets)):
        for i in range(j):
            if root[i] != root[j]:
                n, m = len(sets[i]), len(sets[j])
                if den * min(n, m) < num * max(n, m):
                    continue
                both = n + m - len(np.unique(np.concatenate([sets[i], sets[j]])))
                if den * both >= num * (n + m - both):
                    out.append((i, j))
                    old = root[j]
                    root = [root[i] if x == old else x for x in root]
    return out


def link_groups(pairs: DataFrame, payloads: DataFrame, to_sets: Callable, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Components (id, component) of all links inside the groups of pairs (leader, rep).

    payloads (rep, payload) holds what to_sets makes sets of, for every rep of the pairs at least; it is read once a round.
    """

    def members(places: DataFrame) -> DataFrame:
        return payloads.join(places, "rep").select("rep", "comp", "payload", F.explode("places").alias("p")).select("p.leader", "p.block", "rep", "comp", "payload")

    sizes = stored(pairs.groupBy("leader").agg(F.ceil(F.count("*") / float(block)).cast("long").alias("blocks")), "groups")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    # the places of a leader that is in very many blocks come in several rows
    part = F.floor(F.col("block") / PLACES).cast("long").alias("part")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    gather = F.collect_list(F.struct("leader", "block")).alias("places")
    sized = pairs.join(sizes, "leader")
    placed = sized.select("rep", "leader", F.explode(F.when(F.col("rep") == F.col("leader"), upto("blocks")).otherwise(F.array(own))).alias("block"))
    first = placed.groupBy("rep", part).agg(gather).select("rep", F.col("rep").alias("comp"), "places", "part")
    links = stored(link_blocks(members(first), to_sets, num, den), "links")
    found = stored(connected(links), "components")
    if not sizes.where("blocks > 1").limit(1).count():
        return found
    comp = found.select(F.col("id").alias("rep"), F.col("component").alias("comp"))
    split = sized.where("blocks > 1").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    head = split.where("rep = leader").select("leader", F.col("comp").alias("head"))
    split = stored(split.join(head, "leader").withColumn("out", F.col("comp") != F.col("head")), "split")
    apart = split.where("out").groupBy("leader").agg(F.ceil(F.count("*") / float(block)).cast("long").alias("chunks"))
    late = split.join(apart, "leader").withColumn("own", own).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")))
    one = late.select("rep", "comp", "leader", "chunks", "own", F.explode(upto("chunks")).alias("c")).select("rep", "comp", "leader", (F.col("own") * F.col("chunks") + F.col("c")).alias("block"))
    two = late.where("out").select("rep", "comp", "leader", "chunks", "chunk", F.explode(upto("blocks")).alias("o")).select("rep", "comp", "leader", (F.col("o") * F.col("chunks") + F.col("chunk")).alias("block"))
    again = one.unionByName(two).distinct().groupBy("rep", "comp", part).agg(gather)
    more = stored(link_blocks(members(again), to_sets, num, den), "links")
    if more.limit(1).count():
        found = stored(connected(links.unionByName(more)), "components")
    return found


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; more columns are ignored).

    Two documents link when den * intersection >= num * union. Texts that are null or without words have no shingles and
    link with nothing; a text of fewer than k words is one shingle. A row with a null doc_id has a null component. Rows
    that share a doc_id count as one document with the links of each.
    """
    rows = stored(signatures(docs, k, num, den), "shingles")
    some = rows.where("n > 0 and doc_id is not null")
    classes = stored(some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pairs = stored(leaders(reps.select(F.col("doc_id").alias("id"), "n", F.col("prefix").alias("tokens")), num, den, hot), "pairs")

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").alias("payload"))
    found = link_groups(pairs, texts, lambda texts: sets_of(pa.array(texts, pa.string()), k), num, den, block)
    result = rows.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    key = F.struct("d1", "d2", "n")
    several = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("doc_id"), "several")
    if several.limit(1).count():  # the classes of one doc_id are one component
        own = result.join(several, "doc_id", "left_semi").where("rep is not null")
        least = stored(own.groupBy("doc_id").agg(F.min("rep").alias("least")), "least")
        edges = own.join(least, "doc_id").select(F.col("least").alias("a"), F.col("rep").alias("b"))
        found = stored(connected(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges)), "components")
        result = result.join(least, "doc_id", "left").withColumn("rep", F.coalesce("rep", "least"))
    result = result.join(found.withColumnsRenamed({"id": "rep", "component": "c"}), "rep", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "rep", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the smallest doc_id, with the columns of docs.

    Documents without words stay. Of rows that share a doc_id all stay or go.
    """
    gone = join(docs, k, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([f"`{c}`" for c in docs.columns])
