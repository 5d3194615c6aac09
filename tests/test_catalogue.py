"""Each query of the catalogue against its SQL twin."""

from __future__ import annotations

import pytest

from tablewright.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, small, duck, same, name):
    if name not in SQL:
        assert QUERIES[name](spark, small).count() >= 0
        return
    same(QUERIES[name](spark, small), duck.execute(SQL[name]).df())
