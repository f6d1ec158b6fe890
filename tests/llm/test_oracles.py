from __future__ import annotations

import pytest

from tests.compare import same
from tests.conftest import SMALL, TINY
from volclock.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf_dir", [TINY, SMALL])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name, sf_dir):
    same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)
