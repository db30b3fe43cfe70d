"""Every query of the document engine against DuckDB on the same tables."""

import pytest
from compare import rows

from quire.plans import catalogue, files, service  # noqa: F401  these register their queries


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
