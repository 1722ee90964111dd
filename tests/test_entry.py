"""The entry module in a session that was started elsewhere, before it was imported."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys, tempfile
from pyspark.sql import SparkSession
work = tempfile.mkdtemp(prefix="spark-")
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", work).getOrCreate()
sys.path.insert(0, sys.argv[1])
import __spark_entry__
print("rows", __spark_entry__.queries()["diag_markov_regime"](spark, sys.argv[2]).count())
"""


def test_running_session_gets_the_package(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout, out.stderr[-2000:]


def test_every_query_is_listed_once():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert all(callable(job) for job in known.values())
