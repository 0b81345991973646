import os

import pytest

from marketloom.operators import quality
from marketloom.plans import registry

from .oracle import same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_duckdb(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_dates_are_read_back(spark):
    df = registry.queries()["read_date_fuzzy"](spark, SF)
    assert df.filter("reason is not null or expected <> read").count() == 0
    assert df.filter("corrected").count() > 0


def test_movers_need_no_join_of_facts_and_no_sort(spark):
    plan = registry.queries()["movers_as_of"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_sources_count_all_runs(spark):
    rows = registry.queries()["quality_sources_all"](spark, SF).collect()
    assert sum(r.runs for r in rows) == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert all(r.runs == r.succeeded + r.failed + r.partial for r in rows)


def test_source_without_runs_stays(spark):
    sources = spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, name string")
    runs = spark.createDataFrame([("a", "succeeded", "2024-01-02", 5, 1), ("a", "failed", "2024-01-03", 0, 2)], "source string, status string, started_at string, rows_upserted int, rows_quarantined int")
    a, b = quality.per_source(sources, runs).collect()
    assert (a.runs, a.last_run_at, a.last_success_at, a.rows_upserted, a.success_rate) == (2, "2024-01-03", "2024-01-02", 5, 0.5)
    assert (b.slug, b.runs, b.last_run_at, b.rows_upserted, b.success_rate) == ("b", 0, None, 0, None)
