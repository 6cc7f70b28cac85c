"""Every registered query against the same query in SQL, on the smallest tables."""

import pytest

from check_oracles import compare, connect
from registry import load
from tidegrid.fixtures import Fixtures

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load()))
def test_query(name, spark, duck):
    query = load()[name]
    df = query.run(Fixtures(spark, FOLDER))
    if query.sql:
        assert compare(df, duck, query.sql) == ""
    else:
        assert df.count() > 0
