"""Queries that search first, each as the first one of a new Python process and session."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as e
print("ROWS", len((e.entry(spark) if {name!r} == "entry" else e.queries()[{name!r}](spark, {data!r})).collect()))
"""


@pytest.mark.parametrize("name", ["entry", "answer_nodes", "answer", "seeds", "score_nodes"])
def test_first_query_of_a_session(name):
    got = subprocess.run([sys.executable, "-c", PROGRAM.format(root=str(ROOT), name=name, data=str(DATA))], capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-2000:]
    assert int(got.stdout.split("ROWS")[-1]) > 0
