import os

import pytest

from marketloom import storage
from marketloom.operators.store import Store
from marketloom.streaming import reconcile

from .test_state import batch


def folder(spark):
    return storage.shared_dir(spark).removeprefix("file://").removeprefix("file:")


def names(spark):
    return set(os.listdir(folder(spark)))


def test_what_is_stored_on_the_way_goes_and_what_lasts_stays(spark):
    storage.shared_dir(spark)
    before = names(spark)
    with storage.passing(spark) as at:
        middle = storage.stored(spark.range(10), "middle")
        assert len(os.listdir(at.removeprefix("file://").removeprefix("file:"))) == 1
        with storage.passing(spark):  # one inside another has a folder of its own
            inner = storage.stored(middle.selectExpr("id + 1 as id"), "inner", lasting=True)
        kept = storage.stored(middle.join(inner, "id"), "kept", lasting=True)
    new = names(spark) - before
    assert sorted(n.split("-")[0] for n in new) == ["inner", "kept"]
    assert sorted(r.id for r in kept.collect()) == list(range(1, 10))
    assert [n.split("-")[0] for n in names(spark) - before - new] == []
    storage.stored(spark.range(1), "later")
    assert sorted(n.split("-")[0] for n in names(spark) - before) == ["inner", "kept", "later"]


def test_it_goes_on_failure_too_and_where_nothing_was_stored(spark):
    storage.shared_dir(spark)
    before = names(spark)
    with pytest.raises(OSError), storage.passing(spark):
        storage.stored(spark.range(3), "middle")
        raise OSError("gone")
    with storage.passing(spark):
        pass
    assert names(spark) == before


def test_a_stream_leaves_nothing_but_its_store(spark, tmp_path):
    storage.shared_dir(spark)
    before, at = names(spark), f"file://{tmp_path}/prices"
    sink = reconcile.Upserter(at)
    for i in range(3):
        sink(batch(spark, [(i + 1, "10.00", "a")]), i)
    assert names(spark) == before and Store(spark, at).observations().count() == 3
