"""The driver's entry module, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def run(code: str, cwd: Path, path: str = "") -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": path} if path else {})
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.strip().splitlines()[-1]


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_llm_folders(tmp_path, pipeline):
    shutil.copytree(REPO / "sedimenta", tmp_path / "sedimenta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if pipeline:
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    assert int(run("import __spark_entry__ as e; print(len(e.queries()))", tmp_path)) > 90


def test_names_and_flagship(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_workers_need_no_path(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from sedimenta.shipping import shipped
from sedimenta.sources.hashing import with_digests
def query(spark, sf):
    return with_digests(spark.createDataFrame([({str(REPO / "README.md")!r},)], "path string"))
print(shipped(query)(spark, "").where("hash is not null").count())
"""
    assert run(code, tmp_path) == "1"
