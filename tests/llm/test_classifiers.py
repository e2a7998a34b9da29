import itertools
import math
import random

import numpy as np
import pytest

from tessera.llm import language, quality
from tessera.llm.common import table

COLUMNS = "doc_id long, text string, lang string, source string, score string"


def test_language_accuracy_and_shape(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    got = language.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and 100 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and abs(sum(r.lang_mix.values()) - 1) < 1e-6 for r in got if r.lang_mix)


def test_mixture_recovers_proportions():
    r = np.random.default_rng(1)
    p = np.full((language.BUCKETS, 3), 1e-6)
    for k in range(3):
        p[k * 100 : k * 100 + 150, k] = 1
    p /= p.sum(0)
    counts = r.multinomial(4000, 0.7 * p[:, 0] + 0.3 * p[:, 1])
    at = np.flatnonzero(counts)
    pi, _, _ = language.mixture(p[at], counts[at].astype(float))
    assert abs(pi[0] - 0.7) < 0.05 and abs(pi[1] - 0.3) < 0.05 and pi[2] < 0.01


def test_language_edge_rows(spark):
    base = [(i, t, l, "s", "kept?") for i, (t, l) in enumerate([("the cat and the dog went there", "en"), ("der hund und die katze gehen heim", "de")] * 20)]
    odd = [(100, None, "en", None, None), (101, "", None, "s", "x"), (102, "12 ... !!", "en", "s", "x"), (103, "the dog " * 30000, None, "s", "x"), (None, "der hund", None, "s", "x")]
    docs = spark.createDataFrame(base + odd, COLUMNS)
    got = {r.doc_id: r for r in language.predict_documents(docs).collect()}
    assert len(got) == 45
    assert [got[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert got[100].score == 0 and got[0].lang_pred == "en"
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 42 and kept.where("score = 'kept?'").count() == 40
    assert language.predict_documents(docs.limit(0)).collect() == []
    no_lang = docs.withColumn("lang", docs.lang.substr(100, 1)).withColumn("lang", docs.source.substr(0, 0)).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.predict_documents(no_lang).collect()} == {"und"}


def test_every_one_of_many_languages_is_learned(spark, monkeypatch):
    r = random.Random(4)
    words = {f"l{k:03}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(12)] for k in range(250)}
    rows = [(i, " ".join(r.choices(words[k], k=40)), k) for i, k in enumerate(list(words) * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for cells in (language.MODEL_CELLS, 250 << 12):
        monkeypatch.setattr(language, "MODEL_CELLS", cells)
        model = language.fit(docs, ~language.held_out(5, 0))
        assert model.languages == sorted(words) and model.probability.size <= cells and model.bits == (15 if cells > 250 << 15 else 12)
        got = language.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
        assert sum(x.lang == x.lang_pred for x in got) >= 0.98 * len(got) and len({x.lang for x in got}) > 200
    monkeypatch.setattr(language, "MODEL_CELLS", 250 << 7)
    with pytest.raises(ValueError, match="languages are more than a model"):
        language.fit(docs, docs.doc_id >= 0)


def test_keep_known_rejects_foreign_and_random_letters(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.1"), "documents")
    letters = random.Random(1)
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", *("".join(letters.choices("abcdefghijklmnopqrstuvwxyz ", k=k)) for k in (60, 600, 6000)),
    ]
    clean = ["All human beings are born free and equal in dignity and rights.", "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Tous les êtres humains naissent libres et égaux."]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(strange + clean)], "doc_id long, text string")
    kept = {r.doc_id for r in language.keep_known(docs.unionByName(more, allowMissingColumns=True)).select("doc_id").collect()}
    assert {i for i in kept if i < 0} == {-1 - len(strange), -2 - len(strange)}
    assert len([i for i in kept if i >= 0]) >= 0.9999 * docs.count()


def test_quality_held_out(spark, sf):
    d = sf.replace("0.001", "0.1")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 1000 and sum(r.predicted == r.quality for r in got) >= 0.98 * len(got)


def test_quality_edge_rows(spark):
    good = [(i, f"A plain sentence number {i} that reads well.", "en", "s", "a") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} ### $$$ BUY!!", "en", "s", "b") for i in range(60)]
    odd = [(300, None, None, None, None), (301, "", "en", "s", "c"), (302, "x" * 3_000_000, "en", "s", "d"), (303, "BUY!! " * 100000, "en", "s", "e"), (None, "plain", None, None, None)]
    docs = spark.createDataFrame(good + bad + odd, COLUMNS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(300, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == 125 and got[300].score == got[301].score
    assert all(got[i].predicted == (i < 100) for i in list(range(60)) + list(range(100, 160)))
    assert got[303].predicted == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} >= {"a"}
    assert quality.score_documents(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def plain_ftrl(examples):
    """The update of each coordinate as it is published, in plain Python."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * quality.L1) / ((quality.RATE_BASE + math.sqrt(n[i])) / quality.RATE + quality.L2)

    for features, label, importance in examples:
        w = {i: weight(i) for i in features}
        p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in features.items())))
        for i, x in features.items():
            g = (p - label) * importance * x
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.RATE
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_against_a_plain_loop():
    r = random.Random(11)
    examples = [({i: r.random() for i in r.sample(range(30), r.randint(1, 8))}, r.randint(0, 1), r.choice([0.5, 1.0, 2.0])) for _ in range(400)]
    model = quality.Ftrl(31)
    for features, label, importance in examples:
        model.learn(np.array(list(features)), np.array(list(features.values())), label, importance)
    want = plain_ftrl(examples)
    assert np.allclose(model.weights(np.arange(31)), [want.get(i, 0.0) for i in range(31)], atol=1e-12)
    assert any(w == 0 for w in plain_ftrl(examples[:2]).values()) or len(want) == 30


def test_training_takes_the_examples_in_one_order(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} {'good' if i % 2 else 'bad!!'} text") for i in range(60)] + [(3, None), (3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 0), (8, 5)], "doc_id long, quality int")
    one = quality.fit(docs, labels)
    assert (one == quality.fit(docs.repartition(7), labels.repartition(3))).all() and np.count_nonzero(one) > 10
    assert (quality.fit(docs.limit(0), labels) == 0).all()


def plain_mixture(p, c, rounds=400):
    """EM over single n-grams: who drew each, then the shares."""
    k = len(p[0])
    pi = [1 / k] * k
    for _ in range(rounds):
        total = [0.0] * k
        for row, n in zip(p, c):
            mixed = sum(a * b for a, b in zip(pi, row))
            for j in range(k):
                total[j] += n * pi[j] * row[j] / mixed
        pi = [t / sum(c) for t in total]
    return pi, sum(n * math.log(sum(a * b for a, b in zip(pi, row))) for row, n in zip(p, c))


@pytest.mark.parametrize("seed", range(5))
def test_em_and_selection_against_plain_loops(seed):
    r = np.random.default_rng(seed)
    p = r.dirichlet(np.full(40, 0.3), 4).T + 1e-4
    p /= p.sum(0)
    true = [np.array([1, 0, 0, 0.0]), np.array([0.5, 0.5, 0, 0]), np.array([0.4, 0, 0.6, 0]), np.array([0.3, 0.3, 0.4, 0]), np.array([0, 0, 0.2, 0.8])][seed]
    c = r.multinomial(3000, p @ true).astype(float)
    at = np.flatnonzero(c)
    pi, mixed, value = language.mixture(p[at], c[at], rounds=400)
    want, best = plain_mixture(p[at].tolist(), c[at].tolist())
    assert np.allclose(pi, want, atol=0.02) and abs(value - best) < 1.0
    # the chosen set has the best penalised likelihood of all sets
    price = language.PENALTY * math.log(c.sum() + 1)
    sets = [s for k in range(1, 5) for s in itertools.combinations(range(4), k)]
    worth = {s: plain_mixture(p[np.ix_(at, s)].tolist(), c[at].tolist(), 150)[1] - price * (len(s) - 1) for s in sets}
    found = language.select(p[at], c[at])
    assert set(found[0]) == set(max(worth, key=worth.get)) == set(np.flatnonzero(true).tolist())


def test_repeated_documents_are_judged_alike(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    twice = docs.unionByName(docs).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "lang", "text"))
    for found in (language.predict_documents(twice), quality.score_documents(twice, table(spark, sf, "labels"))):
        rows = found.select("doc_id", "score").collect()
        assert len(rows) == 2 * docs.count() + 1 and len({tuple(r) for r in rows}) == docs.count() + 1


def test_stages_keep_columns_named_like_their_own(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog went there", "en", "mine", 0.5, "m", 1) for i in range(30)], "doc_id long, text string, lang string, _lang_pred string, _LANG_SCORE double, _quality_score string, _quality_class int")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    for kept in (language.keep_known(docs), quality.keep_good(docs, labels)):
        assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())


def test_features_by_hand():
    text = "Ab ab  ab 12\nX"
    rows = np.array([0, len(text), len(text)])
    index, row, words = quality.features(np.frombuffer(text.encode(), np.uint8), rows)
    assert words.tolist() == [5, 0] and len(index) == 5 + 4 + 5 + 4 + 1 and set(row) == {0}


@pytest.mark.parametrize("seed", range(3))
def test_scores_dont_depend_on_batches(seed):
    r = random.Random(seed)
    texts = ["".join(r.choices("ab .!É", k=r.randint(0, 40))) for _ in range(20)]
    w = np.random.default_rng(seed).normal(size=(1 << quality.BITS) + 1)

    def scored(part):
        data = "".join(part).encode()
        off = np.cumsum([0] + [len(t.encode()) for t in part])
        index, row, words = quality.features(np.frombuffer(data, np.uint8), off)
        return np.bincount(row, w[index], len(part)) / np.maximum(words, 1)

    assert np.allclose(scored(texts), np.concatenate([scored([t]) for t in texts]))
