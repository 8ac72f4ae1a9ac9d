"""The search for the nearest documents runs once, whatever ways ask for it."""

import os

import pytest

from tessera.plans import catalog, dispatching

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", ["dispatch_contexts", "dispatch_without_rounds"])
def test_search_is_stored(spark, monkeypatch, name):
    stored, original = [], dispatching.written
    monkeypatch.setattr(dispatching, "written", lambda df: stored.append(df) or original(df))
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(stored) == 1 and "MapInArrow" not in plan
