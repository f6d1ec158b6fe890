"""Every query of the library's own operators against DuckDB."""

from __future__ import annotations

import pytest

from tests.compare import same
from tests.conftest import SMALL
from volclock.plans.oracles import ORACLE_SQL
from volclock.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).collect() is not None
