"""Every query of the package against its SQL."""

import pytest
from against import differences
from conftest import SMALLEST

from velumra.plans import queries

WITHOUT = {"centrality_full", "topology_hash", "mlp_train"}


def test_every_query_has_sql_or_a_reason():
    assert queries.QUERIES.keys() - queries.ORACLES.keys() == WITHOUT
    assert not queries.ORACLES.keys() - queries.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALLEST), queries.ORACLES[name], SMALLEST) == ""


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALLEST).count() > 0
