"""The driver contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).count() > 0


def test_works_without_the_training_data_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for gone in ("prismgrid/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "repo" / gone, ignore_errors=True)
    (tmp_path / "repo/corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
