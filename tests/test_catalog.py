import pytest

from hopwise.plans import catalog
from tests.oracle import differences

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    d = "/root/testdata/sf0.001"
    if name in SQL:
        assert not differences(spark, catalog.queries()[name], SQL[name], d)
    else:
        assert catalog.queries()[name](spark, d).count() > 0
