"""Workers import the package though they are started in another folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.checkpoint.dir", {shared!r}).config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.queries()["b25_b26_title_ratio"](spark, {data!r}).count())
spark.stop()
"""


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="the given tables aren't here")
def test_a_session_of_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=str(ROOT), shared=str(tmp_path / "shared"), data=DATA)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in run.stdout, run.stderr[-3000:]
    assert int(run.stdout.split("ROWS")[1]) > 0
