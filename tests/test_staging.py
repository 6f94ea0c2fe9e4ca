"""Sessions that name no shared folder."""

import os
import subprocess
import sys
from pathlib import Path

PLAIN = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from tallyloom.staging import shared_folder, staged
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = shared_folder(spark)
assert first.startswith("file:///") and shared_folder(spark) == first
assert staged(spark.range(5)).count() == 5
spark.range(3).checkpoint().count()
print("done", first)
"""


def test_a_plain_session_stages_in_one_new_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    found = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=180)
    assert found.returncode == 0 and "done file://" in found.stdout, found.stderr[-2000:]
