"""Every registered query of the library against its SQL."""

import pytest

import spanforge.queries  # noqa: F401
from spanforge.plans.catalog import ORACLE_SQL, QUERIES

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, same):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name])
