"""The entry module from another folder: workers must find the package without help."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
sys.path.remove({ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("a02_decode_wav", "c03_best_match", "d20_beat_coherence"):
    assert entry.queries()[name](spark, {SF!r}).count()
print("done")
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
