"""Every query with SQL gives what DuckDB gives on the smallest data; the others run."""

import pytest

import __spark_entry__ as entry
from compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    ok, said = compare(spark, name, SF)
    assert ok is not False, said


def test_entry(spark):
    assert entry.entry(spark).count() > 0
