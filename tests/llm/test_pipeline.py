import random

import corpus_pipeline
import pytest
from tests.llm.test_lines import brute as lines_brute
from tests.llm.test_similarity import brute as join_brute

from tessera.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.01"
    docs, out, folder = table(spark, sf, "documents"), [], tmp_path_factory.mktemp("stages")
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_and_ids(steps):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[-1] == ids[-2] and len(ids[-1]) > 500
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_keeps_clean_documents(steps):
    gone = {r.doc_id for r in steps[0].join(steps[1], "doc_id", "left_anti").collect()}
    assert len(gone) <= 2


def test_quality_drops_labelled_junk(spark, steps):
    labels = table(spark, "/root/testdata/sf0.01", "labels").join(steps[1].select("doc_id"), "doc_id")
    kept = {r.doc_id for r in steps[2].select("doc_id").collect()}
    rows = labels.collect()
    assert sum(r.doc_id in kept for r in rows if r.quality == 1) >= 0.99 * sum(r.quality for r in rows)
    assert sum(r.doc_id in kept for r in rows if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in rows)


def test_lines_and_near_copies_against_brute_force(steps):
    want, _ = lines_brute(texts(steps[2]))
    got = dict(texts(steps[3]))
    assert all(not want[i].strip() for i in set(want) - set(got))
    assert sum(got[i] != want[i] for i in got) <= 0.01 * len(got)
    links = join_brute(texts(steps[3]), 5, 80, 100)
    assert {i for i, _ in texts(steps[4])} == {i for i, (_, c) in links.items() if c == i}


def test_run_gives_the_last_stage(spark, steps):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert got.columns == [*cols, "sequence_id", "offset"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, steps[5].select(cols).collect()))


def small_corpus(spark, folder, rows):
    """Documents with columns named like helpers of the stages, and labels, as tables in a folder."""
    columns = "doc_id long, text string, lang string, source string, n_chars int, _id int, _keep string, _lang_pred string, _quality_score double, _n_lines int, sequence_id long, offset long, rep string, comp int"
    docs = spark.createDataFrame([(*r, "s", 7, 1, "k", "xx", 0.25, 3, 4, 5, "r", 6) for r in rows], columns)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if text and "$$" in text else 1, 0) for i, text, _ in rows if i is not None and i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    r = random.Random(3)
    plain = [(i, " ".join(r.choices("the cat and dog went over there with some more words of plain text today".split(), k=30)) + f" {i}.", "en") for i in range(60)]
    junk = [(100 + i, f"BUY $$ NOW $$ {i} !!! $$ ### buy $$", "en") for i in range(40)]
    odd = [(200, None, "en"), (201, "", "en"), (202, " \n\t", None), (203, "12 34 ??", "en"), (None, plain[3][1], "en"), (204, plain[5][1], None), (204, "the other cat went over there today", "en"), (205, "a very long word " + "the cat went over " * 30000, "en")]
    small_corpus(spark, tmp_path, plain + junk + odd + [plain[7]])
    docs = table(spark, str(tmp_path), "documents")
    wanted = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == wanted
        assert docs.select("_id", "_keep", "_lang_pred", "_quality_score", "_n_lines", "sequence_id", "offset", "rep", "comp").distinct().collect() == [(1, "k", "xx", 0.25, 3, 4, 5, "r", 6)]
    kept = [x.doc_id for x in docs.collect()]
    assert {200, 201, 202, 203}.isdisjoint(kept) and None in kept and 205 in kept and not any(k and 100 <= k < 140 for k in kept)
    assert 204 not in kept  # its rows are one document, a copy of document 5
    assert len([k for k in kept if k is not None and k < 60]) >= 55
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(kept)


def test_an_empty_corpus(spark, tmp_path):
    small_corpus(spark, tmp_path, [])
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op9_ngram_jaccard", "op10_chat_formatting"])
def test_query_equals_oracle(spark, name):
    import duckdb

    from tessera.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    with duckdb.connect() as db:
        for t in ("documents", "conversations"):
            db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = db.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
