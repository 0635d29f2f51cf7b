"""Partitions of the star graph's edges."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from knotwork import runtime
from knotwork.plans.star_graph import star_graph

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
def test_pairs_of_lines_are_dealt_by_rows(spark, monkeypatch):
    """Partitions of distinct pairs stay of one size while the lines grow."""
    monkeypatch.setattr(runtime, "PARTITION_ROWS", 500)
    edges = star_graph(spark, str(SF)).edges.where("type IN ('links', 'inherits')")
    assert edges.groupBy("type", F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000
