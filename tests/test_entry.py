import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left_out", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_imports_without_the_optional_subpackage(tmp_path, left_out):
    to = tmp_path / "copy"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out))
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 90 and not any(x.startswith('op') or x == 'pipeline' for x in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=to, check=True, env={**os.environ, "PYTHONPATH": str(to)})
