"""Every query of the core library against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import duck_rows, spark_rows

from framequarry import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    names, rows = spark_rows(catalog.QUERIES[name](spark, SMALL))
    assert names
    if name in catalog.ORACLES:
        assert (names, rows) == duck_rows(SMALL, catalog.ORACLES[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
