import pytest
from oracle import connect, differences

from foliant.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    assert differences(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF) == []
