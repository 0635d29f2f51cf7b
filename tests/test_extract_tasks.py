"""Sources made of a table's rows are parsed by as many tasks as their number asks for."""

from pathlib import Path

import pytest

from knotwork.plans import registry

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
def test_files_of_one_row_group_are_dealt(spark, monkeypatch):
    assert registry.table(spark, str(SF), "customer").rdd.getNumPartitions() == 1
    monkeypatch.setattr(registry, "FILES_A_TASK", 40, raising=False)
    got = registry.QUERIES["extract_python_calls"](spark, str(SF))
    assert got.rdd.getNumPartitions() > 2 and got.count() == 3 * registry.table(spark, str(SF), "customer").count()
