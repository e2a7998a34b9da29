import random

import numpy as np
import pytest

from tessera.llm import lines
from tessera.llm.common import table
from tests.llm.test_similarity import roots

SPACE = " \t\n\r\v\f"


def grams(x):
    return frozenset(x[i : i + 8] for i in range(len(x) - 7)) or frozenset([x])


def brute(docs):
    """Texts after removing all lines whose component has an earlier line, by comparing all pairs."""
    all_lines = [(i, k, x.strip(SPACE)) for i, t in sorted(docs) for k, x in enumerate((t or "").split("\n")) if x.strip(SPACE)]
    sets = {x: grams(x) for _, _, x in all_lines}
    index, edges, order = {x: n for n, x in enumerate(sets)}, [], list(sets)
    holders = {}
    for x, s in sets.items():
        both = {}
        for g in s:
            for y in holders.setdefault(g, []):
                both[y] = both.get(y, 0) + 1
            holders[g].append(x)
        edges += [(index[x], index[y]) for y, n in both.items() if 10 * n >= 8 * (len(s) + len(sets[y]) - n)]
    found = roots(edges + [(n, n) for n in range(len(order))])
    seen, gone = set(), set()
    for i, k, x in all_lines:
        c = found[index[x]]
        if c in seen:
            gone.add((i, k))
        seen.add(c)
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}, gone


def run(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r for r in lines.dedup_lines(df, **more).collect()}


def test_spans():
    text = "a\n\n  b c \n\t\nd", "", "\n", "x\n", "é "
    data = "".join(text).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in text])
    start, end, row, number = lines.line_spans(np.frombuffer(data, np.uint8), off)
    assert [(data[a:b].decode(), int(r), int(n)) for a, b, r, n in zip(start, end, row, number)] == [("a", 0, 0), ("b c", 0, 2), ("d", 0, 4), ("x", 3, 0), ("é", 4, 0)]


def test_shingle_sets_are_exact():
    r = random.Random(4)
    texts = ["".join(r.choices("abé", k=r.randint(1, 14))) for _ in range(400)]
    sets = lines.shingle_sets(texts)
    same = {}
    for t, s in zip(texts, sets):
        assert len(s) == len(grams(t))
        assert same.setdefault(grams(t), s.tobytes()) == s.tobytes()
    assert len(set(same.values())) == len(same)


def test_recall_of_bands():
    r = random.Random(9)
    met = total = 0
    for _ in range(150):
        base = [f"w{r.randint(0, 99999)}" for _ in range(45)]
        own = list(base)
        for _ in range(2):
            own[r.randrange(45)] = f"v{r.randint(0, 99999)}"
        a, b = " ".join(base), " ".join(own)
        x, y = grams(a), grams(b)
        if len(x & y) >= 0.8 * len(x | y):
            total += 1
            h = lines.bands([a, b])
            met += (h[0] == h[1]).any()
    assert total > 50 and met >= 0.98 * total


@pytest.mark.parametrize("block, hot", [(lines.BLOCK, lines.HOT), (8, 5)])
def test_against_brute_force(spark, block, hot):
    r = random.Random(block)
    base = [" ".join(f"w{r.randint(0, 3000)}" for _ in range(30)) for _ in range(60)]
    docs = []
    for i in range(150):
        own = []
        for _ in range(r.randint(0, 6)):
            words = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                words[r.randrange(30)] = f"e{r.randint(0, 9999)}"
            own.append(r.choice(["", " ", "\t"]) + " ".join(words) + r.choice(["", " ", "\r"]))
            if r.random() < 0.2:
                own.append(r.choice(["", "  ", "As.", "ok"]))
        docs.append((i, "\n".join(own)))
    want, gone = brute(docs)
    got = run(spark, docs, block=block, hot=hot)
    wrong = [i for i in want if got[i].text != want[i]]
    assert len(gone) > 200 and len(wrong) <= 2  # banding may miss a pair, seldom


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want, _ = brute(docs)
    got = run(spark, docs)
    assert sum(got[i].text != want[i] for i in want) <= 0.01 * len(want)


def test_texts_that_share_an_id(spark):
    r = random.Random(6)
    a, b = (" ".join(f"w{r.randint(0, 10**6)}" for _ in range(30)) for _ in range(2))
    docs = [(1, "first\n\n" + a), (1, "short"), (1, None), (2, b), (2, "other one"), (3, a + "."), (4, b + ".")]
    for rows in (docs, docs[::-1]):
        got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((x.doc_id, x.n_lines, x.n_removed) for x in got) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 1, 0), (3, 1, 1), (4, 1, 1)]


def test_columns_named_like_helpers(spark):
    names = ["_id", "_keep", "_n_lines", "_n_removed"]
    df = spark.createDataFrame([(1, "a line of some words", 1, 2, 3, 4), (2, "a line of some words\nmore words here", 5, 6, 7, 8)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert [tuple(r[2:6]) for r in lines.dedup_lines(df).orderBy("doc_id").collect()] == [(1, 2, 3, 4), (5, 6, 7, 8)]
    assert [tuple(r) for r in lines.keep_fresh(df).orderBy("doc_id").collect()] == [(1, "a line of some words", 1, 2, 3, 4), (2, "more words here", 5, 6, 7, 8)]


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "\n \n"), (4, "Hi\nHi\nhi"), (5, "Hi"), (6, "a longer line of text\n\nHi"), (7, "a longer line of text."), (8, "long " * 40000), (9, "x\n" * 5000)]
    df = spark.createDataFrame([(i, t, 3, "z") for i, t in docs] + [(None, "Hi", 3, "z")], "doc_id long, text string, n_lines int, keep string")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert [got[i].text for i in (1, 2, 3, 4, 5, 6, 8, None)] == [None, "", "\n \n", "Hi\nhi", "", "a longer line of text\n", "long " * 40000, "Hi"]
    assert got[7].text == "" and got[9].text.count("x") == 1 and got[9].n_lines == 5000 and got[4].n_removed == 1
    kept = lines.keep_fresh(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 8, 9, None}
    assert {r.n_lines for r in kept.collect()} == {3}
    assert lines.dedup_lines(df.limit(0)).collect() == []
