"""Operators on frames of the caller's own making, with workers that have no copy of the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
#: Workers inherit this: the same interpreter, and no path to the package.
ENV = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not (Path(p) / "studylake").exists())}
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})  # the driver's path; the workers don't see it
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from studylake.llm import period_runs, simhash_dedup
docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
print(period_runs.find_runs(docs).count(), simhash_dedup.near_duplicates(docs).filter("component_id = 1").count())
"""


def test_public_entries_ship_the_package(tmp_path):
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=ENV)
    assert said.returncode == 0, said.stderr[-2000:]
    assert said.stdout.split() == ["2", "2"]
