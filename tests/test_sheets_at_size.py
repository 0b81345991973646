"""Sheets whose reading must not grow faster than their rows, and cells read one way or another."""

import re

from pyspark.sql import functions as F

from marketloom.functions.text import field_for, read_amount
from marketloom.operators import store as stores
from marketloom.plans import sheet_queries, store_queries
from marketloom.sources import sheets

SF = "/root/testdata/sf0.001"


def test_amounts_of_one_line_and_of_several(spark):
    cells = ["52", " 1,052.50 ", "", None, " \t ", "n/a", "1e3", "+5", "5.", "7\n", "\n 7 ", "7\n8", "a\nb", "\n", "1 2", " 3", "99999999999"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", read_amount(F.col("c")).alias("r")).select("c", "r.*").collect()
    want = {"52": "52.00", " 1,052.50 ": "1052.50", "7\n": "7.00", "\n 7 ": "7.00", " 3": "3.00"}
    blank, several = ("", None, " \t ", "\n"), ("7\n8", "a\nb")
    for c, value, error in got:
        assert (value and str(value)) == want.get(c), c
        said = None if c in want or c in blank else f"several values in one cell: {c}" if c in several else f"not a number: {c}"
        assert error == said, c


def test_fields_by_their_beginning(spark):
    labels = [("Provin", "province"), ("PROVINCE", "province"), ("Market ", "market"), ("Marke", None), ("Municipality/City", "municipality"), ("Date of", "observed_on"), ("x", None), ("", None), (None, None), ("Provinces", None)]
    got = spark.createDataFrame([(a, i) for i, (a, _) in enumerate(labels)], "a string, i int").select("i", field_for(F.col("a")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: f for i, (_, f) in enumerate(labels)}


def test_labels_ahead_are_found_in_one_pass(spark):
    n = 3000
    rows = [("f", i, 0, ["LATE" if i == n - 1 else "", "x", "", "kg", "1", "1", "1", "1"]) for i in range(n)]
    grouped = sheets.with_groups(sheets.classified(spark.createDataFrame(rows, "file_sha string, row_no int, page int, cells array<string>")))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.split("== Initial Plan ==")[0].lower()
    got = {r.row_no: r.group for r in grouped.select("row_no", "group").collect()}
    assert got == {i: None if i == 0 else "LATE" for i in range(n)}


def test_a_store_reads_the_tables_once_for_all_runs(spark, monkeypatch):
    read = []

    def noted(store, run, read_sheets, dims, *more):
        read.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (*read_sheets(), *dims.values()))
        return store.commit()

    monkeypatch.setattr(store_queries, "run_ingest", noted)
    assert isinstance(store_queries._filled(spark, SF, again=True), stores.Store)
    assert len(read) == 3 * 6 and not any(re.search("Join|Window|Aggregate", p) for p in read)


def test_headers_are_dealt_by_a_number(spark):
    headers = sheet_queries._headers(spark, SF)
    plan = headers._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and headers.count() == headers.select("file_sha").distinct().count()
