"""Workers that cannot import the package."""

import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"

RUN = """
import sys
sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
def can(_):
    try:
        import cadenza
        return [1]
    except ImportError:
        return [0]
assert spark.sparkContext.parallelize([1], 1).mapPartitions(can).collect() == [0]
import __spark_entry__
for name, f in __spark_entry__.queries().items():
    if name.startswith(("op", "pipeline")):
        assert f(spark, {sf!r}).count() > 0 or name == "op2_decontaminate", name
        print(name)
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_workers_without_the_package(tmp_path):
    (tmp_path / "run.py").write_text(RUN.format(here=HERE, sf=SF))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, timeout=600, capture_output=True, text=True)
    assert got.returncode == 0, got.stdout + got.stderr[-3000:]
    assert len(got.stdout.split()) == 11
