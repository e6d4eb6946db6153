import os

import pytest

import __spark_entry__ as entry
from compare import difference

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "id", "instruction", "input", "output", "language"]
    assert df.count() > 0


def test_every_query_has_sql():
    """Those of the training-data operators that SQL cannot express are tested in their own folder."""
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) <= set(entry.LLM_QUERIES)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(entry.queries()[name], entry.oracle_sql()[name], spark, SF_DIR) is None
