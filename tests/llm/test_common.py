"""Intermediate tables without a setting, in an application of its own."""

import os
import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
from bibloom.llm import queries
from bibloom.llm.common import materialize, shared_folder
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert materialize(spark.range(7)).count() == 7
assert shared_folder(spark) == shared_folder(spark) and shared_folder(spark).startswith("file:///")
assert queries.op3_sharding(spark, "/root/testdata/sf0.001").count() == 200
"""


def test_folder_without_a_setting(tmp_path):
    (tmp_path / "spark-defaults.conf").write_text("")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
