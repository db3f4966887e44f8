import os
import subprocess
import sys

from tests.conftest import ROOT, SF

CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from parsefold.queries import QUERIES
for name in ("g1_paginate", "g2_split_passages", "m1_m2_player"):
    assert QUERIES[name](spark, {SF!r}).count() > 0
spark.stop()
"""


def test_queries_run_from_another_folder_without_a_path(tmp_path):
    """Workers do not find this package where they start: it is sent to them."""
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, timeout=300, env=os.environ | {"PYSPARK_PYTHON": sys.executable, "PYTHONPATH": ":".join(p for p in sys.path if p and ROOT not in p)})
