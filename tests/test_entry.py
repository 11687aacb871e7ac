"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
