import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, bpe_automaton, packing, tokens

ODD = [
    "", " ", "\n\n  a", None, "It's  we'll\tgo\r\n  ", "naïve ÀÉ ß", "x" * 5000, "aé" * 300, "日本語 text", "İstanbul ǅ",
    "a<|endoftext|>b <|startoftext|>", "é    \x1c\x85 z", "###!!?? --- ***", "ha" * 77 + " 12345", "퟿\U0001f600 ok",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, extra int")


def test_word_cache_equals_library():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [t or "" for t in ODD] + ["".join(random.Random(i).choices(" \n\tabC1é'.,s!", k=60)) for i in range(1500)]
    for text, ids in zip(texts, tokens.WordCachedEncoder(tokens.byte_bpe(), limit=50).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_word_table_keeps_meeting_keys():
    table = tokens.WordCachedEncoder(tokens.byte_bpe())
    meeting = np.arange(1, 301, dtype=np.uint64) << np.uint64(40)
    others = np.unique(np.random.default_rng(2).integers(1 << 20, 1 << 63, 100_000, dtype=np.uint64))
    keys = np.setdiff1d(np.concatenate([meeting, others]), np.arange(1 << 10, dtype=np.uint64))
    for part in np.array_split(keys, 7):
        assert (table._find(part) == -1).all()
        table._keep(part)
    assert (table._find(keys) == np.arange(len(keys))).all()
    assert (table._find(np.arange(1, 500, dtype=np.uint64)) == -1).all()


def test_new_words_of_each_kind():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(4)
    words = ["".join(r.choices("abcdeéßªxyz", k=r.randint(1, 12))) for _ in range(5000)]
    texts = ["\n".join(words[:2500]), " ".join(words[2500:]), " " + "  ".join(words), "".join(w + r.choice("\n\t .,7 42") for w in words)]
    for text, ids in zip(texts, tokens.WordCachedEncoder(tokens.byte_bpe()).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_automaton_equals_library(spark):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ODD + ["".join(random.Random(i).choices(" \n\tabC1é'.,s!", k=60)) for i in range(1000)]
    got = {r.doc_id: r for r in bpe.text_digests(rows(spark, texts)).collect()}
    whole = {r.doc_id: r for r in bpe.encode_texts(rows(spark, texts)).collect()}
    assert whole[0].extra == 1 and len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert whole[i].ids == ids and whole[i].decoded == decoded, text
        assert got[i][1:] == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())


def merged(word, merges):
    """BPE by its definition: merge after merge, from the left."""
    parts = [*word[:-1], word[-1] + "</w>"]
    for u, v in merges:
        out = []
        for x in parts:
            if out and (out[-1], x) == (u, v) and out[-1] is not None:
                out[-1:] = [u + v, None]  # the mark keeps a merged token from being merged again by this merge
            else:
                out.append(x)
        parts = [x for x in out if x is not None]
    return parts


@pytest.mark.parametrize("seed", range(8))
def test_automaton_of_random_merges(seed):
    r = random.Random(seed)
    base = ["a", "b", "a</w>", "b</w>"]
    names, merges = list(base), []
    for _ in range(40):
        u, v = r.choice([x for x in names if not x.endswith("</w>")]), r.choice(names)
        if u + v not in names:
            names.append(u + v)
            merges.append((u, v))
    automaton = bpe_automaton.Automaton({x: i for i, x in enumerate(names)}, merges, "</w>")
    words = ["".join(r.choices("ab", k=r.randint(1, 15))) for _ in range(300)] + [""]
    ids, off = automaton.encode([w.encode() for w in words])
    for w, a, b in zip(words, off, off[1:]):
        assert [names[i] for i in ids[a:b]] == (merged(w, merges) if w else []), (w, merges)


def test_tables_are_complete_and_do_not_grow():
    automaton = bpe_automaton.load(bpe.word_bpe())
    sizes = {k: len(v) for k, v in vars(automaton).items() if hasattr(v, "__len__")}
    bytes_held = sum(v.nbytes for v in vars(automaton).values() if isinstance(v, np.ndarray))
    tables = [v.copy() for v in vars(automaton).values() if isinstance(v, np.ndarray)]
    r = np.random.default_rng(2)
    words = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in r.integers(1, 12, 100_000)]
    ids, off = automaton.encode(words)
    assert "".join(automaton.labels[i] for i in ids[off[50] : off[51]]) == words[50].decode() + "</w>"
    assert {k: len(v) for k, v in vars(automaton).items() if hasattr(v, "__len__")} == sizes and bytes_held < 150e6
    assert all((a == b).all() for a, b in zip(tables, (v for v in vars(automaton).values() if isinstance(v, np.ndarray))))


def test_automaton_refuses_two_ways_to_one_token():
    with pytest.raises(ValueError):
        bpe_automaton.Automaton({"a": 0, "aa": 1, "aaa": 2}, [("a", "aa"), ("aa", "a")], "</w>")


def test_word_tokens_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a word"), (3, None), (4, "x" * 60000 + " " + "ab " * 50000), (5, ""), (5, ""), (6, " \n\t")], "doc_id long, text string")
    got = sorted(bpe.text_digests(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["a word", "", "x" * 60000 + " " + "ab " * 50000, "", "", " \n\t"]
    assert [r.doc_id for r in got] == [None, 3, 4, 5, 5, 6]
    assert [r.n_tokens for r in got] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert bpe.text_digests(docs.limit(0)).collect() == [] and bpe.encode_texts(docs.limit(0)).collect() == []
    small = bpe.Codec(bpe.word_bpe(), limit=5)
    for t in ("one two three", "four five six seven", "eight nine", "one two"):
        assert small.run([t])[0][0] == len(library.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    cap = r.choice([7, 30, 64, 2048])
    counts = {}
    for _ in range(r.choice([0, 1, 5, 400, 3000])):
        n = r.choice([r.randint(1, cap), cap, min(cap, 3)])
        counts[n] = counts.get(n, 0) + 1
    used, seen = {}, dict.fromkeys(counts, 0)
    for length, first, n, b, each, offset in packing.plan_bins(counts, cap).tolist():
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            used.setdefault(b + k // each, []).append((offset + k % each * length, length))
    assert seen == counts
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= cap
    total = sum(k * v for k, v in counts.items())
    if total:
        assert len(used) <= max(-(-total // cap) * 1.7 + 1, sum(v for k, v in counts.items() if 2 * k > cap))


def test_packing_of_documents(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [t for t in ODD if t is None or "<|" not in t] + ["word and more " * 1500, "q " * 5000] + ["same text"] * 40
    got = packing.pack_documents(rows(spark, texts)).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 2048 for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for spans in by_seq.values():
        spans.sort(key=lambda r: r.offset)
        assert [r.offset for r in spans] == [sum(x.length for x in spans[:k]) for k in range(len(spans))]
        assert sum(r.length for r in spans) <= 2048


def well_placed(rows, capacity):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("salts, salt_rows", [(1, 10**9), (2, 7), (64, 100_000)])
def test_packing_of_a_length_that_most_pieces_have(spark, salts, salt_rows):
    r = random.Random(salts)
    data = [(None if i % 50 == 0 else i // 2, i % 2, r.choice([10, 10, 10, 3, 7, 1, 4]), "s", "o", "q") for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, piece int, length long, _salt string, Offset_ string, sequence_id string")
    got = packing.pack(df.withColumn("_rank", F.lit(1)).withColumn("offset", F.lit(2)), 10, salts, salt_rows)
    assert got.columns == ["doc_id", "piece", "length", "_salt", "Offset_", "_rank", "sequence_id", "offset"]
    rows = got.collect()
    assert sorted(repr(tuple(x[:4])) for x in rows) == sorted(repr(tuple(x[:4])) for x in data)
    total = sum(x[2] for x in data)
    assert well_placed(rows, 10) <= -(-total // 10) + 10
    with pytest.raises(ValueError):
        packing.pack(df, 9, salts, salt_rows)


@pytest.mark.parametrize("seed", range(40))
def test_number_of_bins_against_the_best_one(seed):
    """Small cases against all ways to pack: with pieces above a third, pairs are as many as can be."""
    r = random.Random(seed)
    cap = r.choice([6, 9, 12])
    lengths = sorted((r.randint(1, cap) for _ in range(r.randint(1, 9))), reverse=True)

    def best(left, bins, most):
        if not left:
            return len(bins)
        if len(bins) >= most:
            return most
        for k in {b: i for i, b in enumerate(bins)}.values():
            if bins[k] + left[0] <= cap:
                most = min(most, best(left[1:], [*bins[:k], bins[k] + left[0], *bins[k + 1 :]], most))
        return min(most, best(left[1:], [*bins, left[0]], most))

    counts = {n: lengths.count(n) for n in lengths}
    plan = packing.plan_bins(counts, cap)
    used = len({b + k // each for _, _, n, b, each, _ in plan.tolist() for k in range(n)})
    least = best(lengths, [], len(lengths))
    assert least <= used <= (least if all(3 * n > cap for n in lengths) else 11 * least / 9 + 1)


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(rows(spark, [])).collect() == []


def test_packing_of_repeated_and_unnamed_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (None, "x"), (None, None)], "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 3), (1, 3)] and well_placed(got, 2048) == 1
