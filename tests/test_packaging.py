"""The package reaches the workers wherever Spark was started."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__
found = __spark_entry__.queries()["euclidean_clusters"](spark, "/root/testdata/sf0.001").count()
__spark_entry__.queries()["bounds"](spark, "/root/testdata/sf0.001").count()
print("rows", found, len([f for f in spark.sparkContext.listFiles if f.endswith(".zip")]))
"""


def test_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    rows, files = map(int, done.stdout.split("rows")[-1].split())
    assert rows > 100 and files == 1
