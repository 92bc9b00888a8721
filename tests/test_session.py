"""The session: workers find the package from anywhere, checkpoints are reliable."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

from kartei.session import materialize

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", e.queries()["x09_ps"](spark, {data!r}).count())
"""


def test_workers_import_the_package_from_elsewhere(tiny, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), data=tiny)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]


def test_queries_can_be_listed_without_a_session():
    code = f"import sys; sys.path.insert(0, {str(REPO)!r}); import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=100)
    assert out.stdout.split() == ["True", "True"], out.stderr[-2000:]


def test_materialize_is_a_reliable_checkpoint(spark):
    df = materialize(spark.range(10))
    assert df.count() == 10
    assert not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
