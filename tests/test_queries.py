"""Every query of the core registry beside its DuckDB SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, digest, plain
from turnspan.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    same, note = compare(spark, SF, name)
    if name in registry.ORACLES:
        assert same is True, note
    else:  # no SQL: its operator has tests of its own, here it must give rows and the same ones again
        first, again = ([tuple(map(plain, r)) for r in registry.QUERIES[name](spark, SF).collect()] for _ in range(2))
        assert first and digest(first) == digest(again)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
