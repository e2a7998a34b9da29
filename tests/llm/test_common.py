import pyarrow as pa
import pytest

from tessera.llm import common, language
from tessera.sources import objects


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    """As much of a session as the shared folder asks for."""

    def __init__(self, **conf):
        self.conf = Conf({k.replace("__", "."): v for k, v in conf.items()})


def test_slices_are_bounded_and_whole():
    texts = ["x" * n for n in (5, 0, 3_000_000, 9_000_000, 1, 2, 7_000_000, 2_000_000)] + ["y" * 10] * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    parts = list(common.slices([batch, batch.slice(0, 0), batch.slice(4, 3)]))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts + texts[4:7]
    assert all(p.num_rows <= common.BATCH_ROWS and (p.nbytes <= common.BATCH_BYTES or p.num_rows == 1) for p in parts)
    data, off = common.utf8(parts[1].column(1))
    assert [data[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == parts[1].column(1).to_pylist()


def test_fresh_names():
    assert common.fresh(["a", "_ID", "_id_"], "_id", "a", "b") == ["_id__", "a_", "b"]
    assert common.fresh([], "x", "x") == ["x", "x_"]


@pytest.mark.parametrize("folder", [common.shared_dir, objects.shared_folder])
def test_a_cluster_needs_a_shared_folder(folder):
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            folder(Session(spark__master=master))
        assert folder(Session(spark__master=master, spark__checkpoint__dir="hdfs://x/y/")) == "hdfs://x/y"
    local = Session(spark__master="local[4]")
    assert folder(local) == folder(local) == local.conf["spark.checkpoint.dir"]


def test_the_sessions_batch_size_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    assert language.predict_documents(docs).count() == 1 and spark.conf.get(key) == before


def test_stored_tables_can_be_erased(spark, tmp_path):
    import os

    df, path = common.kept(spark.range(3), "gone")
    assert df.count() == 3 and os.path.isdir(path)
    common.erase(spark, path)
    assert not os.path.exists(path)
