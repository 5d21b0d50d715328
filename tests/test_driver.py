"""The driver's way in: a session that somebody else made, without any setting of this library."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as driver
print("ROWS", driver.entry(spark).count())
for name in ("validate_openings", "dedupe_first_arrival", "links_sent_to", "vector_knn"):
    print("ROWS", driver.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_a_plain_session(tmp_path):
    env = {**os.environ, "PYTHONPATH": REPO, "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("ROWS") == 5, done.stderr[-2000:]
