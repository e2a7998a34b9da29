import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.operators import devices, network, ordering, tasks
from tessera.sources import files, objects
from tessera.streaming import telemetry

DEVICE = "ordinal int, backend string, id string, name string, vendor string, type string, units int, memory long"


def test_lenient_parse(spark):
    good = {"backend": "OPENCL", "id": "opencl:1", "name": "A", "vendor": "V", "type": "DISCRETE_GPU", "computeUnits": 20, "memory": 4278190080}
    cpu = {"backend": "JAVA_CPU", "id": "cpu:0", "type": "CPU"}
    arrays = [[good, cpu], [dict(good, backend="QUANTUM_ANNEALER"), cpu], [{"nonsense": True}, good, dict(cpu, id=None)], []]
    rows = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(arrays)] + [(9, None), (10, "junk")], "k int, j string")
    got = devices.parse(rows, "j", "k").orderBy("k", "ordinal").collect()
    assert [(r.k, r.id) for r in got] == [(0, "opencl:1"), (0, "cpu:0"), (1, "cpu:0"), (2, "opencl:1")]
    assert (got[1].name, got[1].units, got[1].memory) == ("", 1, 1)


def test_ranking(spark):
    rows = [(1, "JAVA_CPU", "c", "n", "v", "CPU", 8, 16 << 30), (2, "OPENCL", "i", "n", "v", "INTEGRATED_GPU", 24, 1536 << 20), (3, "OPENCL", "d", "n", "v", "DISCRETE_GPU", 20, 4 << 30), (4, "OPENCL", "e", "n", "v", "DISCRETE_GPU", 40, 2 << 30)]
    df = spark.createDataFrame(rows, DEVICE)
    assert devices.best(df).first().id == "d" and devices.best(df.where("id <> 'd'")).first().id == "e"
    assert devices.best(df.limit(0)).collect() == []
    assert devices.describe(df.limit(0)).first().description == "No compute devices detected"
    assert devices.describe(df.where("ordinal = 3")).first().description == "OPENCL:n (DISCRETE_GPU, 20 CUs, 4096 MB)"


def test_every_device_is_described(spark, sf):
    sf = sf.replace("0.001", "0.1")
    got = catalogue.QUERIES["device_describe"](spark, sf).orderBy("block").collect()
    rows = catalogue.device_rows(spark, sf)
    assert len(got) == 20 and max(r.description.count("\n") + 1 for r in got) == catalogue.DESCRIBED
    assert "\n".join(r.description for r in got) == devices.describe(rows).first().description
    assert sum(r.description.count("\n") + 1 for r in got) == rows.count() == 20000
    assert devices.describe(rows.limit(0), "type").collect() == []


def test_hops(spark):
    rows = [(1, "a", "x", 5, 100), (2, "a", "x", 7, 200), (3, "a", "y", 3, 50), (4, "b", "x", 1, 700), (5, "a", "x", 9, 200)]
    hops = spark.createDataFrame(rows, "ordinal int, dst string, via string, distance long, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    up = network.upsert_hops(hops)
    assert {(r.dst, r.via): r.distance for r in up.collect()} == {("a", "x"): 9, ("a", "y"): 3, ("b", "x"): 1}
    as_of = F.timestamp_seconds(F.lit(799)).cast("timestamp_ntz")
    assert {(r.dst, r.via) for r in network.expire(up, as_of).collect()} == {("a", "x"), ("b", "x")}
    near = network.nearest(network.expire(up, as_of), spark.createDataFrame([("a",), ("c",)], "dst string"))
    assert {tuple(r) for r in near.collect()} == {("a", "x", 9), ("c", "Empty", 2**63 - 1)}


def test_comparators(spark):
    df = spark.createDataFrame([(1, 5, "b"), (2, 5, "a"), (3, 9, "c")], "ip int, distance int, ping_score string")
    got = ordering.top(df, ordering.comparator(ordering.ip_keys(), "-distance", "PING_SCORE"), 2).collect()
    assert [(r.ip, r.position) for r in got] == [(3, 1), (2, 2)]
    with pytest.raises(ValueError):
        ordering.comparator(ordering.ip_keys(), "NOTHING")
    assert len(ordering.node_keys()) == 20 and len(ordering.task_keys()) == 8


def test_sorts(spark):
    df = spark.range(1000).select(F.expr("pmod(xxhash64(id), 300)").alias("k"))
    keys = sorted(r.k for r in df.collect())
    assert [r.k for r in ordering.range_sort(df, "k").collect()] == keys
    assert {r.k: (r.first_rank, r.n) for r in ordering.global_ranks(df, "k").collect()} == {k: (keys.index(k) + 1, keys.count(k)) for k in set(keys)}
    assert ordering.global_ranks(df.limit(0), "k").collect() == []


def test_every_address_has_a_position(spark, sf):
    for scale, n in (("0.01", 100), ("0.1", 1000)):
        d = sf.replace("0.001", scale)
        rows = catalogue.read(spark, d, "supplier").collect()
        want = [r.s_suppkey for r in sorted(rows, key=lambda r: (r.s_nationkey, -r.s_acctbal, r.s_suppkey))]
        got = catalogue.QUERIES["ip_sort"](spark, d).orderBy("position").collect()
        assert len(got) == n and [tuple(r) for r in got] == [(k, i + 1) for i, k in enumerate(want)]
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"))
    for orders in ([F.col("k").desc(), F.col("id").asc()], [F.col("k").asc()]):
        got = ordering.placed(df, orders).orderBy("position").collect()
        assert [r.position for r in got] == list(range(1, 501)) and {r.id for r in got} == set(range(500))
    assert [r.k for r in got] == sorted(r.k for r in got)
    assert ordering.placed(df.limit(0), orders).collect() == []


def test_levels(spark):
    graph = tasks.TaskGraph().define("a").define("b", "a").define("c", "a", "b", "a").define("d", "gone").depend("d", "c")
    assert {r.name: r.level for r in tasks.levels(graph.frame(spark)).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert len(tasks.merge_tree(20).tasks) == 39
    with pytest.raises(ValueError, match="cycle"):
        tasks.levels(graph.depend("a", "c").frame(spark))
    twice = graph.frame(spark)
    assert tasks.distinct_tasks(twice.unionByName(twice.withColumn("id", F.col("id") + 100))).count() == 4


def test_store(spark, tmp_path):
    store = objects.ObjectStore(spark, str(tmp_path))
    store.publish(spark.range(5), "numbers", 0)
    store.publish(spark.range(7), "numbers", 0)
    assert store.resolve("numbers", 0).count() == 7 and store.receive("numbers", 0, tries=1).count() == 7
    assert all(len(r.checksum) == 40 for r in store.manifest().collect())
    with pytest.raises(TimeoutError):
        store.receive("numbers", 1, sleep=0.01, tries=2)
    assert [store.publish(spark.range(k)).rsplit("name=", 1)[1] for k in (1, 2)] == ["object-0/instance=0", "object-1/instance=0"]
    assert store.receive("object-1", tries=1).count() == 2
    assert {r.path.rsplit(".", 1)[1] for r in store.manifest("*.parquet").collect()} == {"parquet"}


def test_half_written_and_damaged_objects(spark, tmp_path):
    store = objects.ObjectStore(spark, str(tmp_path))
    spark.range(5).write.parquet(store.path("half", 0))  # no manifest yet
    with pytest.raises(TimeoutError):
        store.receive("half", 0, sleep=0.01, tries=2)
    path = store.publish(spark.range(100).coalesce(1), "bad", 0)
    spark.range(3).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="differ"):
        store.receive("bad", 0, sleep=0.01, tries=2)
    store.publish(spark.range(8), "bad", 0)
    assert store.receive("bad", 0, tries=1).count() == 8


def test_ties_of_last_writes(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "c", 2), ("k", "b", 2)], "key string, value string, seq int")
    for df in (rows, rows.orderBy("value")):
        assert objects.last_write(df, ["key"], "value", "seq").first().value == "c"


def test_registry_never_raises(spark):
    registry = devices.Registry()
    assert registry.backends(spark).collect() == [] and registry.devices(spark).collect() == []
    asked = []

    def fails():
        asked.append(1)
        raise RuntimeError("boom")

    registry.register("A", fails)
    registry.register("B", lambda: devices.local(spark, cores=3, memory=1 << 30))
    registry.register("LATE", lambda: devices.local(spark).withColumn("units", F.raise_error(F.lit("no")).cast("int")))
    for _ in range(2):
        rows = {r.backend: r for r in registry.backends(spark).collect()}
    assert len(asked) == 1 and rows["A"].reason == "A failed: boom" and rows["B"].available and not rows["LATE"].available
    found = registry.devices(spark).collect()
    assert [(r.registered, r.id, r.units) for r in found] == [("B", "cpu:0", 3)] and devices.best(registry.devices(spark)).first().type == "CPU"
    registry.register("A", lambda: None)
    assert "no driver" in registry.backends(spark).where("backend = 'A'").first().reason


def test_strict_devices(spark):
    df = spark.createDataFrame([("a", " x "), (" ", "y")], "id string, name string").withColumn("vendor", F.lit(None).cast("string"))
    assert [tuple(r) for r in devices.normalise(df).collect()] == [("a", "x", "Unknown vendor")]
    with pytest.raises(Exception, match="needs an id"):
        devices.normalise(df, strict=True).collect()


def test_sections():
    graph = tasks.TaskGraph()
    with graph.parallel_for(0, 100, "equal") as loop:
        graph.define("body", duration=2, resources=("cpu", "disk", "net"))
    with graph.simulate() as outer:
        graph.define("a", "body", duration=3)
        with graph.simulate() as inner:
            graph.define("b", duration=4)
    assert loop["tasks"] == ["body"] and outer["tasks"] == ["a", "b"] and inner["tasks"] == ["b"] and inner["inside"] == outer["number"]
    assert [r[2:4] for r in graph.chunks_of(loop, 2)] == [(0, 50), (51, 100)] and graph.simulated_length(outer) == 7
    assert graph.prioritise("body", "net", "gpu").tasks["body"]["resources"] == ["net", "gpu", "cpu", "disk"]


def test_large_graphs_are_levelled_by_joins(spark, monkeypatch):
    monkeypatch.setattr(tasks, "SMALL", 1)
    graph = tasks.TaskGraph().define("a").define("b", "a").define("c", "a", "b", "a").define("d", "gone").depend("d", "c")
    assert {r.name: r.level for r in tasks.levels(graph.frame(spark)).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    with pytest.raises(ValueError, match="cycle"):
        tasks.levels(graph.depend("a", "c").frame(spark))


def test_positions_in_sorted_output(spark):
    df = spark.range(500).select(F.expr("pmod(xxhash64(id), 90)").alias("k"), "id")
    got = ordering.as_sorted(ordering.range_sort(df, "k", "id")).orderBy("position").collect()
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in df.collect()) and [r.position for r in got] == list(range(1, 501))
    unsorted = ordering.as_sorted(df.repartition(3)).orderBy("position").collect()
    assert [(r.k, r.id) for r in unsorted] != sorted((r.k, r.id) for r in unsorted)
    assert ordering.as_sorted(ordering.range_sort(df.limit(0), "k")).collect() == []
    assert ordering.bag_union(df, df, df.limit(1)).count() == 1001


def test_joined_stencils_of_small_rasters(spark):
    from tessera.operators import kernels

    for h, w in ((1, 1), (1, 5), (4, 1), (3, 4)):
        a = np.random.default_rng(h * w).integers(0, 1 << 24, (h, w))
        df = spark.createDataFrame([(y, x, int(a[y, x])) for y in range(h) for x in range(w)], "y long, x long, p int")
        for name in ("blur3", "sharpen", "sobel"):
            want = kernels.by_name(name).numpy(a)
            assert {(r.y, r.x): r.p for r in kernels.apply_joined(df, name).collect()} == {(y, x): int(want[y, x]) for y in range(h) for x in range(w)}
    assert kernels.apply_joined(df.limit(0), "blur3").collect() == []
    with pytest.raises(ValueError):
        kernels.apply_joined(df, "invert")


def test_a_running_stream_can_be_stopped(spark, tmp_path):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    query = telemetry.start(rate, "endless", str(tmp_path / "c"))
    assert query.isActive
    assert telemetry.stop(query, seconds=30) and not query.isActive and telemetry.stop(query)


def test_names_are_resolved_in_order(spark):
    values = spark.createDataFrame([(0, "i", "1"), (1, "I+j", "2"), (2, "J", "3")], "id int, name string, value string")
    exprs = spark.createDataFrame([(1, "I", "k"), (2, "j", "i"), (3, "i", "z")], "ordinal int, string string, right string")
    got = {r.id: r.name for r in objects.resolve_names(values, exprs).collect()}
    assert got == {0: "k", 1: "I+j", 2: "i"}


def test_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"id": 1, "length": 5}, {"id": 2, "startTime": 9}]')
    rows = files.task_trace(spark, str(tmp_path / "t.json"))
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, 0, 5), (2, 9, 0)]
    files.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz")
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first().text == "x\ny\nz"


def test_png():
    a = np.random.default_rng(1).integers(0, 1 << 24, (13, 7))
    assert (files.decode_png(files.encode_png(a)) == a).all()
    with pytest.raises(OSError):
        files.decode_png(b"junk")


def test_streams_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = telemetry.available_now(telemetry.cache_stats_windowed(telemetry.commands(stream)), "windows", "complete", str(tmp_path / "a"))
    want = telemetry.cache_stats_windowed(telemetry.commands(events))
    assert out.exceptAll(want).count() == 0 and out.count() == want.count()
    hops = lambda e: e.select(F.col("user_id").cast("string").alias("dst"), F.col("event_type").alias("via"), F.floor("value").cast("long").alias("distance"), "ts")
    live = telemetry.available_now(telemetry.live_routes(hops(stream)), "routes", "update", str(tmp_path / "b"))
    last = {(r.dst, r.via): r.ts for r in live.where("live").groupBy("dst", "via").agg(F.max("ts").alias("ts")).collect()}
    assert last == {(r.dst, r.via): r.ts for r in hops(events).groupBy("dst", "via").agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).collect()}


def test_schedulers(spark):
    from tessera.plans import scheduling

    nodes = spark.createDataFrame([("b",), ("a",), ("c",)], "node string")
    s = scheduling.RoundRobin("equal")
    assert {(r.chunk_no, r.node) for r in s.schedule_range(nodes, 0, 30).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    two = spark.createDataFrame([(0,), (1,)], "id int")
    assert scheduling.summary(nodes, s.schedule(nodes, two)).first()[:] == (3, 2, 2, 1)
    assert s.schedule(nodes.limit(0), two).where("node is null").count() == 2 and s.errors


def test_elements_and_paths(spark, tmp_path):
    from tessera.operators import kernels

    e = lambda v, seq: spark.createDataFrame([("o", 1, "p", v, seq)], "object string, instance int, position string, value string, seq long")
    objects.append_elements(e("old", 1), str(tmp_path / "e"))
    objects.append_elements(e("new", 2), str(tmp_path / "e"))
    last = objects.last_write(spark.read.parquet(str(tmp_path / "e")), ["object", "instance", "position"], "value", "seq")
    assert objects.element(last, "o", "p", 1).first().value == "new"
    assert objects.random_values(spark, 100, 7).exceptAll(objects.random_values(spark, 100, 7, 3)).count() == 0
    pixels = objects.random_values(spark, 12, 1).select(F.expr("id div 4").alias("y"), (F.col("id") % 4).alias("x"), (F.col("value") % 16777216).alias("p"))
    (a, one), (b, two) = kernels.compute(pixels, "sobel"), kernels.compute(pixels, "sobel", 4, 3, "tiled")
    assert (one, two) == ("windows", "tiled") and a.exceptAll(b.select(*a.columns)).count() == 0
