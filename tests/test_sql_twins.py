"""Every query of the library proper that SQL can say gives the same rows as its twin."""

from __future__ import annotations

import pytest

from dialoom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_rows(name, same_as_sql):
    same_as_sql(catalog.queries()[name], catalog.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_runs(name, spark, data):
    df = catalog.queries()[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    df.count()
