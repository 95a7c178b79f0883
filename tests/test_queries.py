"""Every registered query against its SQL twin."""

import pytest

from threadloom.plans import registry

from .compare import rows_of, twin_rows

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_twin(spark, name):
    found = registry.QUERIES[name](spark, FOLDER)
    columns, expected = twin_rows(registry.SQL[name], FOLDER)
    assert sorted(found.columns) == columns
    ours = rows_of(found.columns, found.collect())
    assert len(ours) == len(expected) and ours
    assert [x for x in zip(ours, expected, strict=True) if x[0] != x[1]][:3] == []
