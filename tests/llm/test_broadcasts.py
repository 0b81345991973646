"""Sides of joins are broadcast by their counted rows, never by the size that Spark supposes."""

import random

import pytest

from marketloom.llm import common, components, neardup


@pytest.fixture
def docs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        own = [rnd.choice(words) for _ in range(60)]
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join([*own[:-1], "end"])), (3 * i + 2, " ".join(own))]
    rows += [(0, " ".join(rnd.choice(words) for _ in range(60))), (None, "a b"), (900, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture
def plans(monkeypatch):
    """The plan of each table that is stored, by name, as Spark means to run it."""
    found, stored = [], common.stored

    def noted(df, name, **more):
        found.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name, **more)

    for module in (neardup, components):
        monkeypatch.setattr(module, "stored", noted)
    return found


def test_no_side_is_broadcast_unless_counted(spark, docs, plans, monkeypatch):
    common.prepared(spark)
    want = sorted(map(str, neardup.near_duplicates(docs).collect()))
    assert sum("kept=False" in r for r in want) >= 80 and any("BroadcastHashJoin" in p for _, p in plans)
    # The rows of all tables are many more than Spark takes them for.
    joined = [p for name, p in plans if name == "members"]
    assert joined and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in joined)
    plans.clear()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    found = neardup.near_duplicates(docs)
    assert {name for name, p in plans if "BroadcastHashJoin" in p} == set()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, found.collect())) == want
    plans.clear()
    assert neardup.drop_near_duplicates(docs).count() == sum("kept=True" in r for r in want)
    assert {name for name, p in plans if "BroadcastHashJoin" in p} == set()
