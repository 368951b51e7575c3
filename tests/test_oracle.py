"""Every registered query against its SQL, on the given tables."""

import pytest
from compare import connect, differences
from paths import SF_CHECK

from tapeline.plans.oracles import ORACLES
from tapeline.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_CHECK)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, SF_CHECK, QUERIES[name], ORACLES[name], con) is None
