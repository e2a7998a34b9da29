import random
import re

import numpy as np
import pytest

from tessera.llm import components, jaccard
from tessera.llm.common import table


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(150)] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(200)] + [(7, 7), (9000, 9000)]
    df = spark.createDataFrame([*edges, (None, 3), (5, None)], "a long, b long")
    assert {x.id: x.component for x in components.connected(df).collect()} == roots(edges)


def test_no_edges(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(docs, k, num, den):
    sets = {i: shingles(t, k) for i, t in docs}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    edges = [(i, i) for i in sets]
    for a, s in sets.items():
        both = {}
        for x in s:
            for b in holders[x]:
                if b > a:
                    both[b] = both.get(b, 0) + 1
        edges += [(a, b) for b, n in both.items() if den * n >= num * (len(s) + len(sets[b]) - n)]
    found = roots(edges)
    return {i: (len(sets[i]), found[i]) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_join_equals_brute_force_on_documents(spark, sf, k, num):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, num, 100)
    assert got(jaccard.join(docs, k, num, 100)) == want
    assert len({c for _, c in want.values()}) < len(want)


def near_copies(r, n, words, edits):
    base = [f"w{r.randint(0, 5000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(words)] = f"e{r.randint(0, 10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("seed", range(3))
def test_groups_that_are_split(spark, seed):
    r = random.Random(seed)
    texts = [t for _ in range(3) for t in near_copies(r, 60, 120, 6)] + [t for _ in range(40) for t in near_copies(r, 3, 40, 2)]
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [f"{shared} {' '.join(f'u{i}_{j}' for j in range(20))}" for i in range(40)]
    docs = list(enumerate(texts))
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(jaccard.join(df, 4, 85, 100, block=16)) == brute(docs, 4, 85, 100)
    assert got(jaccard.join(df, 4, 85, 100, block=16, hot=3)) == brute(docs, 4, 85, 100)


@pytest.mark.parametrize("num, den", [(0, 1), (80, 100), (1, 1)])
def test_leaders_bring_all_pairs_together(spark, num, den):
    """Whatever way a token goes, two ids that share it and may reach the threshold share a leader."""
    r = random.Random(num)
    sets = [(i, r.choice([10, 12, 13, 40]), [r.choice([1, 2, 2, 3, 10**18, -5, 100 + i]) for _ in range(2)]) for i in range(120)]
    df = spark.createDataFrame([(i, n, list(dict.fromkeys(t))) for i, n, t in sets], "id long, n long, tokens array<long>")
    pairs = [{(x.leader, x.rep) for x in jaccard.leaders(df, num, den, hot).collect()} for hot in (10**6, 30, 0)]
    for found in pairs:
        of = {}
        for leader, rep in found:
            of.setdefault(rep, set()).add(leader)
        assert all((leader, leader) in found for leader, _ in found)
        for i, n, t in sets:
            for j, m, u in sets[:i]:
                best = max((min(n - t.index(x), m - u.index(x)) for x in set(t) & set(u)), default=0)
                if best and (num == 0 or (den + num) * best >= num * (n + m) and den * min(n, m) >= num * max(n, m)):
                    assert of[i] & of[j], (i, j)


def test_texts_that_share_an_id_link_as_one_document(spark):
    r = random.Random(5)
    a, b, c, d = (" ".join(f"w{r.randint(0, 10**6)}" for _ in range(80)) for _ in range(4))
    docs = [(1, a), (3, b), (3, c), (5, b + " x"), (6, c + " y"), (7, a), (7, d), (8, d + " z"), (9, ""), (9, c), (9, c), (10, "alone"), (11, None)]
    want = {1: 1, 3: 3, 5: 3, 6: 3, 7: 1, 8: 1, 9: 3, 10: 10, 11: 11}
    for rows in (docs, docs[::-1]):
        found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
        assert sorted((x.doc_id, x.component_id) for x in found) == [(i, want[i]) for i, _ in docs]


def test_join_edges(spark):
    long = " ".join(f"x{i}" for i in range(60000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (6, "one"), (7, "É é"), (8, "é É"), (9, long), (10, long + " end"), (11, "a b c d e f"), (12, "a b c d e f"), (13, "\x1c\xa0 x")]
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in docs] + [(None, "one two", 1, "z")], "doc_id long, text string, n long, rep string")
    want = brute(docs, 4, 85, 100)
    found = jaccard.join(df, 4, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want and len(found) == 14
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 11, 13]
    assert jaccard.join(df.limit(0)).collect() == [] and jaccard.keep_one(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_tree_finds_all_links(seed):
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(r.integers(2, 60)):
        base = sets[r.integers(len(sets))] if sets and r.random() < 0.7 else r.integers(1, 2**63, r.integers(1, 80), dtype=np.uint64)
        own = base[r.random(len(base)) < 0.95] if len(base) > 3 else base
        sets.append(np.unique(np.concatenate([own, r.integers(1, 2**63, r.integers(0, 3), dtype=np.uint64)])))
    sets = [s if len(s) else np.array([1], np.uint64) for s in sets]
    n = len(sets)
    links = jaccard.SignatureTree(sets).links(8, 10, np.arange(n))
    inter = lambda a, b: len(np.intersect1d(a, b))
    truth = [(a, b) for a in range(n) for b in range(a) if 10 * (m := inter(sets[a], sets[b])) >= 8 * (len(sets[a]) + len(sets[b]) - m)]
    assert set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, truth)))
    assert roots(links + [(i, i) for i in range(n)]) == roots(truth + [(i, i) for i in range(n)])
