"""Every registered query of the engine against its SQL."""

import pytest

from matchloom.plans import registry

@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
