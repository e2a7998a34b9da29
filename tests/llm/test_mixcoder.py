import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import mixcoder, tokens


@pytest.mark.parametrize("n", [0, 1, 2, 4095, 4096, 4097, 13000])
@pytest.mark.parametrize("kind", ["one", "few", "any", "text"])
def test_round_trip(n, kind):
    r = np.random.default_rng(n)
    ids = {"one": np.full(n, 65535), "few": r.integers(0, 3, n), "any": r.integers(0, 65536, n), "text": (r.zipf(1.3, n) - 1) % 50257}[kind].astype("<u4")
    blocks = mixcoder.encode_blocks(ids)
    assert [b[0] for b in blocks] == [min(4096, n - a) for a in range(0, n, 4096)]
    assert (mixcoder.decode_blocks(blocks) == ids).all()
    if kind in ("one", "few") and n > 4000:
        assert sum(len(b[1]) for b in blocks) < n / 2


def test_context_mixing_learns_repeats():
    ids = np.tile(np.random.default_rng(3).integers(0, 50000, 300), 12).astype("<u4")
    assert 8 * len(mixcoder.encode_blocks(ids)[0][1]) < 5 * len(ids)


def test_order0_learns_single_ids():
    r = np.random.default_rng(5)
    ids = r.choice(r.choice(50000, 200, replace=False), 40960).astype("<u4")  # 7.6 bits an id, in no order
    blocks = mixcoder.encode_blocks(ids)
    assert 8 * sum(len(b[1]) for b in blocks) < 10 * len(ids)
    assert (mixcoder.decode_blocks(blocks) == ids).all()


def test_cost_of_an_id():
    r = np.random.default_rng(6)
    ids = ((r.zipf(1.3, 512 * 4096) - 1) % 50257).astype("<u4")
    table, at = np.arange(1 << 20), r.integers(0, 1 << 20, len(ids))

    def seconds(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    def gathers():
        for _ in range(20):
            table[at]

    coding = min(seconds(lambda: mixcoder.decode_blocks(mixcoder.encode_blocks(ids))) for _ in range(2))
    assert coding < 30 * min(seconds(gathers) for _ in range(3))


@pytest.mark.parametrize("lengths", [[4096, 4096, 700, 16, 1], [3000, 17, 15], [64]])
def test_blocks_of_any_lengths_decode_together(lengths):
    r = np.random.default_rng(7)
    parts = [r.integers(0, 65536, n).astype("<u4") for n in lengths]
    blocks = [mixcoder.encode_blocks(p)[0] for p in parts]
    order = r.permutation(len(lengths))
    assert (mixcoder.decode_blocks([blocks[k] for k in order]) == np.concatenate([parts[k] for k in order])).all()


@pytest.mark.parametrize("size", [0, 3, 8, 11, 5000])
def test_any_bytes_are_decoded_or_refused(size):
    with pytest.raises(ValueError):
        mixcoder.decode_blocks([(4096, np.random.default_rng(size).bytes(size), 1)])


def test_blocks_are_independent():
    ids = np.random.default_rng(1).integers(0, 500, 9000).astype("<u4")
    whole = mixcoder.encode_blocks(ids)
    assert mixcoder.encode_blocks(ids[4096:8192]) == [whole[1]]
    assert (mixcoder.decode_blocks([whole[2], whole[1]]) == np.concatenate([ids[8192:], ids[4096:8192]])).all()


def test_damage_is_found():
    data = mixcoder.write_segment([1, 2], [np.arange(3000, dtype="<u4").tobytes(), b"\x05\0\0\0"])
    names, ids = mixcoder.read_segment(data)
    assert names == [1, 2] and ids[1].tolist() == [5]
    for bad in (b"junk", data[:-2], data[:3000] + bytes([data[3000] ^ 8]) + data[3001:]):
        with pytest.raises(ValueError):
            mixcoder.read_segment(bad)
    with pytest.raises(ValueError):
        mixcoder.encode_blocks(np.array([65536]))


def test_files_of_documents(spark):
    library = Tokenizer.from_file(tokens.byte_bpe())
    texts = {9: "later", 1: None, 2: "", -3: "first é", 5: "many words here " * 4000, 7: "###", 100: "x"}
    rows = [(i, t, 0) for i, t in texts.items()] + [(7, "more", 0), (None, "null id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    files = mixcoder.write_files(docs)
    got = mixcoder.through_files(docs).orderBy("start").collect()
    want, at = [], 0
    for i, t in sorted([(i, t) for i, t, _ in rows], key=lambda x: (x[0] is not None, x[0], x[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert files.columns == ["shard", "segment", "n_tokens", "content"]
    assert mixcoder.through_files(docs.limit(0)).collect() == []


def test_segments_of_a_shard(spark, monkeypatch):
    data = [mixcoder.write_segment([a], [np.full(n, 7, "<u4").tobytes()]) for a, n in ((1, 10), (2, 20), (3, 5))]
    files = spark.createDataFrame([(0, 0, 10, data[0]), (0, 1, 20, data[1]), (4, 0, 5, data[2])], "shard int, segment int, n_tokens long, content binary")
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in mixcoder.read_files(files).collect())
    assert got == [(1, 0, 10), (2, 10, 20), (3, 30, 5)]
