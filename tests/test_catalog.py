import pytest

from tests.compare import SF, same
from tidewell.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name])


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
