import os
import shutil
import subprocess
import sys

import pytest

from tests.oracle import SF, same
from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("gone", ["folders", "a library"])
def test_entry_without_llm(tmp_path, gone):
    """A copy without the subpackage, or without a library that it needs, has all other queries."""
    shutil.copytree("tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__") if gone == "folders" else shutil.ignore_patterns("__pycache__"))
    shutil.copy("__spark_entry__.py", tmp_path)
    if gone == "a library":
        shutil.copy("corpus_pipeline.py", tmp_path)
        (tmp_path / "tiktoken.py").write_text("raise ImportError('gone')")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split("\n")
    assert set(said[0].split()) == set(catalog.QUERIES) and set(said[1].split()) == set(catalog.SQL)
