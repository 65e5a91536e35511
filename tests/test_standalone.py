"""The engine without the folders of the corpus operators."""

import os
import shutil
import subprocess
import sys

from conftest import REPO


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(s) <= set(q) and not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in q); print(len(q))"
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=False)
    assert found.returncode == 0, found.stderr
