"""Workers that have no copy of the package get it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
#: Workers inherit this: the same interpreter, and no path to the package.
ENV = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not (Path(p) / "studylake").exists())}
CODE = """
import sys
sys.path.insert(0, {root!r})  # the driver's path; the workers don't see it
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
{body}
"""


def run(body: str, folder: Path) -> str:
    said = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), body=body)], cwd=folder, capture_output=True, text=True, timeout=300, env=ENV)
    assert said.returncode == 0, said.stderr[-2000:]
    return said.stdout


def test_readers_and_writers_ship_the_package(tmp_path):
    body = """
from studylake.sources import files, streams
rows = spark.createDataFrame([("p", "1", "{}", {"a": b"x"})], "packageKey string, version string, manifest string, media map<string,binary>")
path = files.write_containers(files.containers(rows), files.scratch(spark, "c"))
print(files.read_containers(spark, path).count(), streams.read_entries(files._binary(spark, path).selectExpr("path", "'a' AS name")).select("content").toPandas()["content"][0])
"""
    assert run(body, tmp_path).split() == ["1", "b'x'"]
