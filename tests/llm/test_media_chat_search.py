import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm import chat, hnsw, matroska
from tessera.llm.common import table

# ---- media -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**35])
def test_vint_round_trip(n):
    assert matroska._size(matroska.vint(n), 0) == (n, len(matroska.vint(n)))
    assert matroska._size(matroska.vint(n, 8), 0) == (n, 8)


@pytest.mark.parametrize("kind", ["xiph", "ebml", "fixed"])
def test_lacing_round_trip(kind):
    r = random.Random(kind)
    for _ in range(200):
        sizes = [r.choice([0, 1, 254, 255, 256, 510, 9000, r.randint(0, 400)]) for _ in range(r.randint(2, 9))]
        if kind == "fixed":
            sizes = [sizes[0]] * len(sizes)
        frames = [r.randbytes(s) for s in sizes]
        flags, body = matroska.lace(frames, kind)
        data = b"head" + body
        assert [data[a : a + n] for a, n in matroska._frames(data, 4, len(data), flags >> 1 & 3)] == frames


@pytest.mark.parametrize("kind", ["fixed", "xiph", "ebml"])
@pytest.mark.parametrize("frames", [1, 7, 8, 9, 128, 129, 700])
def test_file_round_trip(kind, frames):
    payload = random.Random(frames).randbytes(192 * frames)
    data = matroska.write_pcm(payload, kind)
    media = matroska.parse(data)
    assert b"".join(data[a : a + n] for _, _, a, n, *_ in media.packets) == payload
    assert [p[1] for p in media.packets] == [10_000_000 * k for k in range(frames)]
    assert [(t, place) for t, _, place in media.cues] == [(1_280_000_000 * k, p) for k, p in enumerate(media.clusters)]
    assert media.duration_ns == frames * 10_000_000 and media.tracks[0]["codec"] == "A_PCM/INT/LIT"


def test_unknown_sizes_and_block_groups():
    m = matroska
    block = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x82\x00\x05\x00abc") + m.number(m.REFERENCE, 1))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.CLUSTER_TIME, 1000) + block
    data = m._PREAMBLE + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m._TRACKS + cluster * 2 + m.element(0xEC, b"void")
    got = m.parse(data)
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[5], p[6]) for p in got.packets] == [(2, 1_005_000_000, b"abc", c, False) for c in (0, 1)]


def test_broken_files():
    data = matroska.write_pcm(b"x" * 1920)
    r = random.Random(5)
    for _ in range(300):
        bad = bytearray(data[: r.randint(0, len(data))])
        for _ in range(r.randint(0, 3)):
            if bad:
                bad[r.randrange(len(bad))] = r.randrange(256)
        try:
            matroska.parse(bytes(bad))
        except matroska.MatroskaError:
            pass


def with_info(*more):
    m = matroska
    cluster = m.element(m.CLUSTER, m.number(m.CLUSTER_TIME, 1) + m.element(m.SIMPLE_BLOCK, b"\x81\0\0\x80abc"))
    return m._PREAMBLE + m.element(m.SEGMENT, m.element(m.INFO, b"".join(more)) + m._TRACKS + cluster)


@pytest.mark.parametrize("value", [float("nan"), float("inf"), -float("inf"), 1e300])
def test_durations_that_are_no_number(value):
    import struct

    m = matroska
    with pytest.raises(m.MatroskaError):
        m.parse(with_info(m.element(m.DURATION, struct.pack(">d", value))))


def test_numbers_beyond_64_bits():
    m = matroska
    assert m.parse(with_info(m.number(m.TIMESTAMP_SCALE, 10))).packets[0][1] == 10
    for bad in (with_info(m.number(m.TIMESTAMP_SCALE, 1 << 64)), with_info(m.element(m.TIMESTAMP_SCALE, b"\xff" * 2000))):
        with pytest.raises(m.MatroskaError):
            m.parse(bad)
    cue = m.element(m.CUES, m.element(m.CUE_POINT, m.element(m.CUE_TIME, b"\xff" * 9) + m.element(m.CUE_POSITIONS, m.number(m.CUE_TRACK, 1))))
    track = m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, b"\x01" + b"\xff" * 7 + b"\0\0\x80abc"))
    for part in (cue, track):
        with pytest.raises(m.MatroskaError):
            m.parse(m._PREAMBLE + m.element(m.SEGMENT, part))


def test_cue_table(spark):
    data = matroska.write_pcm(b"z" * 192 * 300)
    media = matroska.parse(data)
    rows = matroska.cue_rows(media)
    assert [r[3:] for r in rows] == [(0, 0), (1, 128), (2, 256)] and [r[2] for r in rows] == media.clusters
    media.cues += [(0, 7, media.clusters[0]), (10**15, 1, media.clusters[0]), (0, 1, 3)]
    assert [r[3:] for r in matroska.cue_rows(media)[3:]] == [(0, None), (0, None), (None, None)]
    df = spark.createDataFrame([(1, data, "a"), (2, None, "b"), (3, b"no", "c")], "id long, media binary, cue string")
    got = matroska.cue_table(df).orderBy("id", "cue.time_ns").collect()
    assert [(r.id, r.cue and tuple(r.cue), r.error is None) for r in got] == [*((1, r, True) for r in rows), (3, None, False)]


def test_odd_media_files(spark):
    import struct

    bad = with_info(matroska.element(matroska.DURATION, struct.pack(">d", float("nan"))))
    df = spark.createDataFrame([(1, 3, None), (2, 3, bad), (None, 3, matroska.store_text("abc")), (4, 0, b"")], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in matroska.read_media(df).collect()}
    assert got[1][2:] == (None,) * 6 and got[2].payload_sha256 is None and "64-bit" in got[2].feature and got[None].payload_bytes == 192
    assert got[4].media_bytes == 0 and got[4].feature.startswith("error=")
    assert [r.error for r in matroska.packet_table(df.where("doc_id = 2")).collect()] == ["the duration is no 64-bit number"]
    names = spark.createDataFrame([(1, bytearray(matroska.store_text("a")), 5, "x")], "error long, media binary, packet long, media_ string")
    assert matroska.packet_table(names).columns == ["media_", "packet", "error"]
    assert matroska.packet_table(names.limit(0)).collect() == []


def test_media_of_documents(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "long text " * 20000, "a"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in matroska.read_media(matroska.store_texts(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert got[i][1:5] == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert got[i].media_sha256 == sha256(matroska.store_text(t)).hexdigest()
    assert got[2][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    assert matroska.read_media(matroska.store_texts(docs.limit(0))).collect() == []


def test_packet_table(spark):
    rows = [(1, matroska.write_pcm(b"y" * 1920), "k"), (2, b"junk", "k"), (3, None, None), (4, b"", "")]
    got = matroska.packet_table(spark.createDataFrame(rows, "id long, media binary, track string")).collect()
    assert len([r for r in got if r.id == 1]) == 10 and {r.error is None for r in got if r.id in (2, 4)} == {False}
    assert {r.track for r in got if r.id == 1} == {"k"} and sorted({r.id for r in got}) == [1, 2, 4]


# ---- chat --------------------------------------------------------------------------------------------------------


def test_escape_is_reversible():
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(r.choices(["\\", "<turn>", "</turn>", "</", "turn>", "\n", "o", "c", "n", "é"], k=r.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text and not re.search("</?turn>", chat.escape(text))


def expected(rows):
    rows = [(a or "", b or "") for a, b in rows]
    said = "".join(b for a, b in rows if a == "assistant")
    return len(rows), sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest(), len(said), sha256(said.encode()).hexdigest()


def test_conversations(spark):
    trap = "\\### Assistant: </turn> ok"
    talks = {-7: [("user", trap), ("assistant", trap)], 1: [("user", "</turn>\n"), ("assistant", None), ("assistant", "</"), (None, "é\\")], 2: [("a\nb<turn>", "<turn>")], 3: [("user", "x" * 300_000)]}
    talks[4] = [("assistant" if i % 2 else "user", f"turn {i} </turn> \\") for i in range(2500)]
    rows = [(c, i, a, b, "more") for c, said in talks.items() for i, (a, b) in enumerate(said)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    parts = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    assert {c: tuple(got[c][1:5]) for c in got} == {c: expected(x) for c, x in talks.items()}
    assert got[-7].formatted_chars == sum(len(f"<turn>{a}\n{chat.escape(b)}</turn>\n") for a, b in talks[-7])
    assert parts.where("conv_id = 4").count() > 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


def test_ties_and_null_ids(spark):
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "assistant", "z"), (5, 0, "user", "a"), (5, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r[1:5]) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {None: expected([("assistant", "z"), ("user", "a"), ("user", "b")]), 5: expected([("user", "a")] * 2)}


# ---- search ------------------------------------------------------------------------------------------------------


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i in range(0, len(ids)):
        if ids[i] % 20 == 0:
            s = (x * x[i]).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
            out[ids[i]] = [(int(ids[j]), s[j]) for j in order]
    return out


def check(found, want, least):
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        assert [r.rank for r in rows] == list(range(1, len(want[q]) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len({r.vec_id for r in rows} & {j for j, _ in want[q]})
    assert hits >= least * sum(map(len, want.values()))


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_recall(spark, spread):
    r = np.random.default_rng(2)
    v = r.normal(size=(1500, 32)) * np.exp(spread * r.normal(size=(1500, 1)))
    v[100:400] = v[100]
    rows = [(int(i), [float(x) for x in row.astype(np.float32)]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(hnsw.search(df, df.where("vec_id % 20 = 0"), 20, shard_rows=500).collect(), brute(rows, 20), 0.95)


def test_queries_ask_few_cells_where_vectors_have_clusters(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 16)) * 6
    v = np.concatenate([centres[r.integers(12)] + r.normal(size=(1, 16)) for _ in range(2400)])
    v[:800] = centres[0] + 0.5 * r.normal(size=(800, 16))  # a third of all rows in one place
    rows = [(int(i), [float(x) for x in row.astype(np.float32)]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.where("vec_id % 20 = 0")
    check(hnsw.search(df, queries, 20, shard_rows=100).collect(), brute(rows, 20), 0.95)
    index, cells = hnsw.build_index(df, 20, shard_rows=100)
    assert index.count() == sum(n for _, n in cells.shards.values()) and len(cells.pivots[16]) == 24
    assert max(len(x.ids) for x in index.select("ids").collect()) < 200 and sum(len(x.ids) for x in index.select("ids").collect()) == 2400
    probes = hnsw.probes_needed(index, cells, hnsw._usable(queries), (np.float32, np.float32), 20, 120)
    assert 1 < probes < 16


def test_vectors_of_several_lengths(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(size=3 + i % 2).astype(np.float32)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.search(df, df.where("vec_id % 20 < 2"), 20, shard_rows=60, most_cells=5).collect()
    assert {x.query_id % 2 for x in got} == {0, 1} and all(x.query_id % 2 == x.vec_id % 2 for x in got) and len(got) == 800


def test_search_edges(spark):
    bad = [(0, None), (20, [0.0, 0.0]), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (None, [1.0, 1.0]), (140, [])]
    good = [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [1.0, 2.0]), (103, [-1.0, 0.0]), (100, [1.0, 2.0]), (120, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in bad + good], "vec_id long, embedding array<float>, rank string")
    got = hnsw.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(100, 1, 101, 5.0), (100, 2, 102, 5.0), (100, 3, 103, -1.0)]
    assert hnsw.search(df.limit(0), df.limit(0)).collect() == []


def test_ties_go_to_the_smallest_ids(spark):
    r = np.random.default_rng(8)
    tied = [(int(i), [2.0, *map(float, r.normal(size=3).round(2))]) for i in r.permutation(np.arange(1, 111))]
    low = [(1000 + i, [-1.0, *map(float, r.normal(size=3).round(2))]) for i in range(50)]
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), *tied, *low], "vec_id long, embedding array<float>")
    found = hnsw.search(df, df.where("vec_id = 0"), ef=400).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in found] == [(i, 2.0) for i in range(1, 21)]
    many = hnsw.search(df, df.where("vec_id = 0"), ef=400, shard_rows=1).orderBy("rank").collect()  # over 64 shards
    assert [x.vec_id for x in many] == list(range(1, 21))


def test_double_components_are_not_rounded(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0 + 1e-12, 3.0]), (2, [1.0, 5.0]), (3, [1.0 + 2e-12, 0.5])], "vec_id long, embedding array<double>")
    found = hnsw.search(df, df.where("vec_id = 20")).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in found] == [(3, 1.0 + 2e-12), (1, 1.0 + 1e-12), (2, 1.0)]
    whole = spark.createDataFrame([(20, [1, 0]), (1, [3, 3])], "vec_id long, embedding array<int>")
    assert [(x.vec_id, x.score) for x in hnsw.search(whole, whole.where("vec_id = 20")).collect()] == [(1, 3.0)]


def test_graph_survives_its_bytes():
    v = np.random.default_rng(0).normal(size=(300, 8))
    g = hnsw.Graph(v)
    h = hnsw.Graph.from_bytes(g.to_bytes())
    assert all(set(g.search(q, 5)) == set(h.search(q, 5)) for q in v[:20])


def test_whole_tables(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    check(hnsw.search(e, e.where("vec_id % 20 = 0")).collect(), brute(rows, 20), 0.95)
