import pytest
from compare import same_rows

from terralex.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    if name in ORACLES:
        same_rows(df, duck, ORACLES[name])
    else:
        assert df.count() > 0
