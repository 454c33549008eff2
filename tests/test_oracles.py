"""Every registered query beside its DuckDB check; rows-only queries must return rows."""

import pytest
from compare import DATA, connect, difference

from evidentia.plans import catalog

SF = "0.001"
CHECKS = catalog.checks()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n in CHECKS))
def test_matches_check(spark, con, name):
    assert difference(spark, con, name, catalog.QUERIES[name], CHECKS[name], SF) is None


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n not in CHECKS))
def test_returns_rows(spark, name):
    assert catalog.QUERIES[name](spark, f"{DATA}/sf{SF}").count() > 0
