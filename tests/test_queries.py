import pytest

import __spark_entry__ as entry
from marketloom import catalogue
from tests.oracle import differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    assert differences(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
