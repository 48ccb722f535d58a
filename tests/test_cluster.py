"""Queries whose driver and executors are processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

RUN = """
import threading
from pyspark.sql import SparkSession
from brindle.plans.queries import QUERIES
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").getOrCreate()
f = lambda s: print("rows", sorted(map(tuple, QUERIES["jdbc_scan"](s, "").repartition(2).collect())), flush=True)
f(spark)
f(spark.newSession())
t = threading.Thread(target=f, args=(spark,))
t.start()
t.join()
spark.stop()
"""


def test_jdbc_scan_reads_in_other_processes(tmp_path):
    home, cwd = tmp_path / "home", tmp_path / "cwd"
    (home / "work").mkdir(parents=True)  # of the executors
    cwd.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": f"{Path(__file__).parents[1]}:{os.environ.get('PYTHONPATH', '')}"}
    out = subprocess.run([sys.executable, "-c", RUN], cwd=cwd, env=env, capture_output=True, text=True, timeout=180)
    assert [x for x in out.stdout.splitlines() if x.startswith("rows")] == ["rows [(2, 'b'), (3, 'c')]"] * 3, out.stderr[-3000:]
