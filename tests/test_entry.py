import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

WITHOUT = """
import __spark_entry__ as e
assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_without_the_subpackage(tmp_path, also):
    """A copy of the repository without the two folders imports, finds its tests and runs one of its modules."""
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for gone in ("cadenza/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    for gone in also:
        (copy / gone).unlink(missing_ok=True)
    run = lambda *a: subprocess.run([sys.executable, "-B", *a], cwd=copy, check=True, timeout=300, capture_output=True, env=os.environ | {"PYTHONPATH": ""})
    run("-c", WITHOUT)
    run("-m", "pytest", "-q", "--collect-only", "tests")
    if not also:
        run("-m", "pytest", "-q", "-x", "tests/test_documents.py")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
