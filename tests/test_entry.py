"""Driver contract: entry() on sf0.001 and the query/oracle registries."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E
from quire.plans import catalog


@pytest.mark.skipif(not os.path.isdir(E.SMOKE_DIR), reason="driver tables not present")
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "split_index", "target_size", "abstract", "status"]
    rows = df.collect()
    assert len(rows) > 0 and {r.status for r in rows} <= {"ok", "failed"}


def test_registry_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert set(catalog.QUERIES) <= set(q) and all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and s.strip() for s in o.values())


@pytest.mark.parametrize("gone", [("quire/llm",), ("quire/llm", "corpus_pipeline.py")])
def test_imports_without_the_llm_folders(tmp_path, gone):
    """A copy without the subpackage (with or without the pipeline's file)
    still registers every query of the book model."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    left_out = {os.path.join(root, g) for g in gone} | {os.path.join(root, ".git")}
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if os.path.join(d, n) in left_out or n == "__pycache__"])
    code = "import __spark_entry__ as E; print(len(E.queries()), 'pipeline' in E.queries(), any(q.startswith('op1_') for q in E.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(copy)})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False", "False"]
