"""The driver's contract, with and without the training-data part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def own():
    from tessera import catalogue

    return sorted(catalogue.ORACLES)


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", own())
def test_query_equals_oracle(spark, sf, name):
    got = entry.queries()[name](spark, sf)
    names = sorted(got.columns)
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = db.sql(f"select {', '.join(f'"{n}"' for n in names)} from ({entry.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r[n] for n in names) for r in got.collect()) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'k_sobel' in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
