from __future__ import annotations

import compare
import pytest

from cairn.plans import catalogue, sessions  # noqa: F401  sessions adds queries


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in catalogue.ORACLES:
        assert got
        return
    r = compare.connect(sf).execute(catalogue.ORACLES[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = compare.rows(columns, r.fetchall())
    assert compare.rows(df.columns, got) == want
