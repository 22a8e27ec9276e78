"""The library without the operators for training data."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'q_discover' in q and 'pipeline' not in q and set(s) <= set(q) and not any(k.startswith('op') for k in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_llm(tmp_path, pipeline):
    """Both folders deleted, with the pipeline's file left behind or not."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert not (copy / "rutine" / "llm").exists() and not (copy / "tests" / "llm").exists()
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
