import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.plans import chunks, tiles


def sizes(rows):
    return [(r[1], r[2], r[3]) for r in rows]


def test_golden_schedules():
    assert sizes(chunks.schedule("equal", 0, 1000, 4)) == [(1000, 0, 250), (1000, 251, 500), (1000, 501, 750), (1000, 751, 1000)]
    assert sizes(chunks.schedule("equal", 0, 3, 5)) == [(3, 0, 0), (3, 1, 0), (3, 1, 0), (3, 1, 0), (3, 1, 3)]
    assert [s[0] for s in sizes(chunks.schedule("guided", 0, 100, 4))] == [25, 19, 14, 11, 8, 6, 5, 3, 3, 2, 1, 1, 1, 1, 0]
    assert [s[0] for s in sizes(chunks.schedule("factoring", 0, 100, 4))] == [13] * 4 + [6] * 4 + [3] * 4 + [2] * 4 + [1] * 5
    assert sizes(chunks.schedule("trapezoid", 0, 1000, 4, first=0.2, last=0.02))[-2:] == [(46, 938, 983), (24, 984, 1000)]
    assert [s[0] for s in sizes(chunks.schedule("quadratic", 0, 1001, 4, delta=2.0, last=0.1))] == [125, 119, 116, 113, 110, 107, 104, 101, 98, 95]
    assert [len(chunks.schedule(s, 0, 14999, 8)) for s in ("equal", "guided", "factoring", "trapezoid", "quadratic")] == [8, 62, 88, 30, 331]


@pytest.mark.parametrize("strategy", sorted(chunks.STRATEGIES))
@pytest.mark.parametrize("lo,hi,n", [(0, 1000, 4), (-50, 977, 7), (5, 2005, 13), (0, 1500, 1)])
@pytest.mark.parametrize("reverse", [False, True])
def test_every_key_once(strategy, lo, hi, n, reverse):
    try:
        rows = chunks.schedule(strategy, lo, hi, n, reverse)
    except ValueError:
        assert strategy == "trapezoid"  # its sizes may reach zero before the end
        rows = chunks.schedule(strategy, 0, 1000, 4, reverse, first=0.2, last=0.02)
        lo, hi = 0, 1000
    assert sorted(k for _, _, low, up, _ in rows for k in range(low, up + 1)) == list(range(lo, hi + 1))
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))


def plain_real(strategy, lo, hi, n):
    """The sizes of a loop over real numbers, one chunk after the other."""
    d, out, low, i = hi - lo, [], lo, 1
    while True:
        if strategy == "guided":
            size = max(math.ceil((hi - lo if i == 1 else d) / n), 1)
            d -= size
        else:
            size = max(math.ceil(d / (2 * n)), 1)
            d -= size * n * (i % n == 0)
        up = low + size - 1
        out.append((low, min(up, hi)))
        if up >= hi:
            return out
        low, i = up + 1, i + 1


@pytest.mark.parametrize("strategy", ["guided", "factoring"])
@pytest.mark.parametrize("lo, hi, n", [(0.5, 1000.25, 4), (-20.0, 77.75, 3), (0.0, 5.0, 9)])
def test_real_chunks(strategy, lo, hi, n):
    got = chunks.schedule_real(strategy, lo, hi, n)
    assert [(r[2], r[3]) for r in got] == plain_real(strategy, lo, hi, n)
    back = chunks.schedule_real(strategy, lo, hi, n, reverse=True)
    assert [(r[2], r[3]) for r in back] == [(lo + hi - up, lo + hi - low) for low, up in plain_real(strategy, lo, hi, n)]


def test_golden_real_chunks():
    assert [(r[2], r[3]) for r in chunks.schedule_real("equal", 0, 5, 2)] == [(0.0, 2.5), (3.5, 5.0)]
    assert chunks.schedule_real("quadratic", 2, 2.5, 1) == [(1, 0.5, 2.0, 2.5)]
    single = chunks.schedule_real("equal", 0, 1, 3, single=True)
    assert single[0][3] == float(np.float32(1) / np.float32(3)) != 1 / 3
    tss = chunks.schedule_real("trapezoid", 0, 1000, 4)
    assert [round(a[1] - b[1], 6) for a, b in zip(tss, tss[1:])] == [round(tss[0][1] - tss[1][1], 6)] * (len(tss) - 1) and tss[-1][3] == 1000
    for bad in (("trapezoid", 0.5, 1000.25, 4, {"first": 0.2, "last": 0.02}), ("quadratic", 0, 10, 2, {"delta": 0}), ("nothing", 0, 1, 2, {}), ("equal", 0, float("nan"), 2, {}), ("equal", 1, 0, 2, {})):
        with pytest.raises(ValueError):
            chunks.schedule_real(*bad[:4], **bad[4])


def test_real_aggregate_with_odd_keys(spark):
    keys = [0.0, 2.5, 2.6, 3.5, 5.0, None, float("nan"), 3.4999]
    got = chunks.aggregate_real(spark.createDataFrame([(k,) for k in keys], "k double"), "k", "equal", 2).orderBy("chunk_no").collect()
    assert [(r.n_rows, r.least, r.most) for r in got] == [(2, 0.0, 2.5), (2, 3.5, 5.0)]
    assert chunks.aggregate_real(spark.createDataFrame([], "k double"), "k", "equal", 2).collect()[0].n_rows == 0


def test_bad_schedules():
    for call in (("trapezoid", 0, 1000, 4), ("nothing", 0, 1, 1), ("equal", 0, 1, 0), ("equal", 5, 1, 2)):
        with pytest.raises(ValueError):
            chunks.schedule(*call, **({"first": 0.6, "last": 0.0} if call[0] == "trapezoid" else {}))
    with pytest.raises(ValueError):
        chunks.schedule("quadratic", 0, 1000, 4, delta=0.0)


@pytest.mark.parametrize("strategy", ["equal", "guided", "quadratic"])
@pytest.mark.parametrize("n,hi", [(1, 40), (3, 40), (9, 5)])
def test_aggregate_equals_a_loop(spark, strategy, n, hi):
    df = spark.range(hi + 1).select(F.col("id").alias("k"), (F.col("id") * 2).cast("double").alias("v"))
    got = {r.chunk_no: (r.n_rows, r.total) for r in chunks.aggregate(df, "k", "v", strategy, n).collect()}
    for no, _, low, up, _ in chunks.schedule(strategy, 0, hi, n):
        keys = range(low, up + 1)
        assert got[no] == (len(keys), sum(2.0 * k for k in keys) if keys else None)


def test_assignment_has_no_nested_loop(spark):
    plan = chunks.schedule("guided", 0, 999, 8)
    text = chunks.assign(spark.range(1000).withColumnRenamed("id", "k"), "k", plan)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text


def test_delta_sweep_equals_a_loop(spark):
    want, before = [], 0
    for n in (2, 3, 4):
        for k in range(2000):
            delta = round(-10 + k / 100, 9)
            if not delta:
                continue
            done, out = 0, []
            try:
                for _, size in chunks.quadratic_sizes(1001, 1001 // (2 * n), 100, int((1001 // (2 * n) + 100) / delta // 1)):
                    out.append(size)
                    done += size
                    if done > 1001 or len(out) > 5 * n:
                        break
            except ValueError:
                continue
            if len(out) < 5 * n and all(a >= b for a, b in zip(out, out[1:])) and len(out) != before:
                want.append((n, delta, len(out)))
                before = len(out)
    got = chunks.delta_sweep(spark, nodes=range(2, 5), per_unit=100).orderBy("nodes", "delta").collect()
    assert [tuple(r) for r in got] == want and len(want) > 5


def test_replicas_and_monotone(spark):
    c = chunks.chunks(spark, "guided", 0, 100, 4)
    r = chunks.replicas(c, 2)
    assert r.count() == 3 * c.count() and r.where("duplicate_of is null").count() == c.count()
    assert chunks.non_increasing(c.withColumn("s", F.lit(1)), "s").first().non_increasing
    up = spark.createDataFrame([(1, 5, "a"), (2, 6, "a")], "chunk_no int, planned_size long, s string")
    assert not chunks.non_increasing(up, "s").first().non_increasing


@pytest.mark.parametrize("d", [496, 599_999, 899_999, 8_999_999, 10**12])
def test_trapezoid_covers_where_its_sizes_reach_zero(d):
    rows = chunks.schedule("trapezoid", 0, d, 8)
    f, l = int(0.0625 * d), int(0.01 * d)
    step = (f - l) // (2 * d // (f + l) - 1)
    fall = list(range(f, 0, -step))
    assert sum(fall) < d + 1  # so the statement's sizes turn negative and never end
    assert [r[1] for r in rows] == fall + fall[-1:] * (len(rows) - len(fall))
    assert rows[0][2] == 0 and rows[-1][3] == d and all(a[3] + 1 == b[2] for a, b in zip(rows, rows[1:]))
    assert all(0 < r[4] <= r[1] for r in rows) and all(r[4] == r[1] for r in rows[:-1])


def long_lineitem(spark, folder):
    """Order keys over six times the range of sf0.1, with few rows."""
    rows = spark.range(900_000).where("id % 1000 in (0, 999)").select(F.col("id").alias("l_orderkey"), (F.col("id") % 50).cast("double").alias("l_quantity"))
    rows.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_monotone_check_over_a_long_range(spark, tmp_path):
    got = catalogue.QUERIES["chunk_monotone_check"](spark, long_lineitem(spark, tmp_path)).collect()
    want = {s: (True, len(chunks.schedule(s, 0, 899_999, 8))) for s in ("equal", "guided", "factoring", "trapezoid", "quadratic")}
    assert {r.strategy: (r.non_increasing, r.n_chunks) for r in got} == want and want["trapezoid"][1] == 32


def test_trapezoid_query_over_a_long_range(spark, tmp_path):
    got = [tuple(r) for r in catalogue.QUERIES["chunk_tss"](spark, long_lineitem(spark, tmp_path)).orderBy("chunk_no").collect()]
    keys = [k for k in range(900_000) if k % 1000 in (0, 999)]
    assert [r[:4] for r in got[-3:]] == [(30, 3556, 893519, 897074), (31, 1739, 897075, 898813), (32, 1739, 898814, 899999)]
    assert [r[5] for r in got] == [sum(r[2] <= k <= r[3] for k in keys) for r in got] and sum(r[5] for r in got) == len(keys)
    assert [r[6] for r in got] == [float(sum(k % 50 for k in keys if r[2] <= k <= r[3])) for r in got]


def test_reverse_trapezoid_over_a_long_range(spark, tmp_path):
    got = [tuple(r) for r in catalogue.QUERIES["chunk_reverse_tss"](spark, long_lineitem(spark, tmp_path)).orderBy("chunk_no").collect()]
    keys = [k for k in range(900_000) if k % 1000 in (0, 999)]
    assert [r[2:4] for r in got] == [(899_999 - up, 899_999 - low) for _, _, low, up, _ in chunks.schedule("trapezoid", 0, 899_999, 8)]
    assert [r[5] for r in got] == [sum(r[2] <= k <= r[3] for k in keys) for r in got] and sum(r[5] for r in got) == len(keys)
    assert [r[6] for r in got] == [float(sum(k % 50 for k in keys if r[2] <= k <= r[3])) for r in got]


GRIDS = [(1000, 800, 4, 4, 0), (1001, 799, 4, 4, 0), (100, 100, 3, 3, 2), (100, 100, 2, 2, 3), (64, 64, 4, 4, 0), (80, 60, 4, 3, 0), (2, 2, 4, 4, 0)]


@pytest.mark.parametrize("w,h,c,r,halo", GRIDS)
def test_grids_cover_exactly(spark, w, h, c, r, halo):
    g = tiles.grid(spark, w, h, c, r, halo).orderBy("tile").collect()
    assert [t.tile for t in g] == list(range(len(g))) and sum(t.width * t.height for t in g) == w * h and all(t.width and t.height for t in g)
    assert max(t.width for t in g) - min(t.width for t in g) <= 1
    for t in g:
        assert t.read_x == max(0, t.x - halo) and t.read_x + t.read_width == min(w, t.x + t.width + halo)
        assert t.read_y == max(0, t.y - halo) and t.read_y + t.read_height == min(h, t.y + t.height + halo)
    if w * h < 20_000:
        assert tiles.coverage(tiles.grid(spark, w, h, c, r, halo)).first()[:] == (w * h, 0)


def test_golden_rects_and_shapes(spark):
    last = tiles.grid(spark, 100, 100, 2, 2, 3).where("tile = 3").first()
    assert (last.read_x, last.read_y, last.read_width, last.read_height) == (47, 47, 53, 53)
    first = tiles.grid(spark, 100, 100, 2, 2, 5).where("tile = 0").first()
    assert (first.read_x, first.read_y, first.read_width, first.read_height) == (0, 0, 55, 55)
    want = {(1920, 1080, 8): (4, 2), (1920, 1080, 7): (7, 1), (640, 480, 1): (1, 1), (97, 61, 6): (3, 2), (64, 500, 12): (1, 12), (50, 50, 4): (2, 2)}
    assert {k: tiles.shape(*k) for k in want} == want
    assert tiles.for_chunks(spark, 2, 2, 8).count() == 4


@pytest.mark.parametrize("args", [(0, 100, 2, 2, 0), (100, -1, 2, 2, 0), (100, 100, 0, 2, 0), (100, 100, 2, 2, -1)])
def test_bad_grids(spark, args):
    with pytest.raises(ValueError):
        tiles.grid(spark, *args)
    with pytest.raises(ValueError):
        tiles.shape(100, 100, 0)


def noise(spark, w, h, seed=0):
    return spark.range(w * h).select(F.expr(f"id div {w}").alias("y"), (F.col("id") % w).alias("x"), F.expr(f"cast(pmod(xxhash64(id, {seed}), 16777216) as int)").alias("p"))


@pytest.mark.parametrize("w,h,c,r,halo", [(40, 30, 3, 2, 0), (64, 48, 3, 3, 2), (33, 21, 2, 2, 5), (5, 4, 4, 4, 3)])
def test_cut_and_merge(spark, w, h, c, r, halo):
    pixels, g = noise(spark, w, h), tiles.grid(spark, w, h, c, r, halo)
    cut = tiles.read_pixels(pixels, w, h, c, r, halo)
    counts = {x.tile: x["count"] for x in cut.groupBy("tile").count().collect()}
    assert counts == {t.tile: t.read_width * t.read_height for t in g.collect()}
    whole = tiles.merge(g, cut, w, h, c, r)
    assert whole.count() == w * h and whole.exceptAll(pixels.select(*whole.columns)).count() == 0
    with pytest.raises(ValueError, match="2"):
        tiles.merge(g, cut.where("tile <> 2"), w, h, c, r)
    with pytest.raises(IndexError):
        tiles.tile_for(g, g.count())
    assert tiles.tile_for(g, 1).first().tile == 1
    numbers = spark.createDataFrame([(0,), (1,), (g.count(),)], "chunk_no int")
    assert sorted((r.chunk_no, r.tile) for r in tiles.tiles_for(g, numbers).collect()) == [(0, 0), (1, 1)]
