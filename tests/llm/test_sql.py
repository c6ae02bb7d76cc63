"""Queries of the text operators that SQL can express agree with it on the smallest tables."""

from collections import Counter

import pytest

from loam.llm.queries import QUERIES, SQL
from tests.test_queries import plain, twin  # noqa: F401 - a fixture


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, twin, name):  # noqa: F811
    df = QUERIES[name](spark, data)
    found = twin.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert Counter(tuple(plain(v) for v in r) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
