"""Queries whose kernels run in Python workers, started where the package cannot be found by chance."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", {str(ROOT / '__spark_entry__.py')!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["k1_scene_grouping"](spark, "/root/testdata/sf0.001").count())
"""


def test_kernels_reach_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0 and "rows " in ran.stdout, ran.stderr[-2000:]
