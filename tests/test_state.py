import random

from pyspark.sql import functions as F

from marketloom.operators import state
from marketloom.schemas import TABLES

KEY = dict(source="s", market=2, commodity="c")
BATCH = "source string, market long, commodity string, observed_on date, low decimal(14,4), high decimal(14,4), prevailing decimal(14,4), average decimal(14,4), unavailable boolean, source_file_sha256 string, position int"


def batch(spark, rows):
    """rows: (day, average or None, file)."""
    from datetime import date
    from decimal import Decimal as D

    data = [("s", 2, "c", date(2026, 7, d), *([D("52"), D("53"), D("53"), D(a)] if a else [None] * 4), a is None, f, i) for i, (d, a, f) in enumerate(rows)]
    return spark.createDataFrame(data, BATCH)


def run(spark, stored, rows):
    up = state.upsert(stored, batch(spark, rows), now=F.lit("2026-08-01").cast("timestamp"))
    new = spark.createDataFrame(up.state.collect(), TABLES["price_observations"])
    return new, up.revisions.collect(), up.outcome.first().asDict()


def test_insert_repeat_revise_and_conflict(spark):
    empty = spark.createDataFrame([], TABLES["price_observations"])
    one, revs, n = run(spark, empty, [(28, "52.80", "a")])
    assert n == dict(inserted=1, revised=0, unchanged=0, conflicts=0, rejected=0) and not revs and one.first().revision_no == 0
    same, revs, n = run(spark, one, [(28, "52.800", "b"), (28, "52.80", "b")])
    assert n["unchanged"] == 2 and not revs and same.collect() == one.collect()
    two, revs, n = run(spark, one, [(28, "49.00", "b")])
    assert n["revised"] == 1 and two.first().revision_no == 1 and str(revs[0].average) == "52.80" and revs[0].source_file_sha256 == "a" and revs[0].revision_no == 0
    three, revs, _ = run(spark, two, [(28, None, "c")])
    assert three.first().revision_no == 2 and three.first().average is None and not revs[0].unavailable
    disputed, revs, n = run(spark, one, [(28, "52.80", "d"), (28, "49.00", "d"), (27, "1.00", "d")])
    assert (n["conflicts"], n["rejected"], n["inserted"], n["unchanged"]) == (1, 2, 1, 0) and not revs
    assert {str(r.observed_on): r.revision_no for r in disputed.collect()} == {"2026-07-27": 0, "2026-07-28": 0}


def test_half_up(spark):
    got = state.quantised(batch(spark, [(1, "52.805", "a"), (2, "52.005", "a")])).orderBy("observed_on").collect()
    assert [str(r.average) for r in got] == ["52.81", "52.01"]


def test_collapse_and_chain_against_a_plain_model(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(1, 9), str(rnd.choice([10, 10, 11, 12])), "f") for _ in range(120)]
    cut = state.collapse_duplicates(state.quantised(batch(spark, rows)))
    want_rows, want_bad = {}, {}
    for day in range(1, 10):
        own = [a for d, a, _ in rows if d == day]
        differ = [i for i, a in enumerate(own) if a != own[0]]
        if differ:
            want_bad[day] = 1 + len(own) - differ[0]
        elif own:
            want_rows[day] = own[0]
    assert {r.observed_on.day: str(int(r.average)) for r in cut.settled.collect()} == want_rows
    assert {r.observed_on.day: r.rows_rejected for r in cut.conflicts.collect()} == want_bad
    chain = state.revision_chain(batch(spark, rows), "position").collect()
    for day in {d for d, _, _ in rows}:
        own = [a for d, a, _ in rows if d == day]
        changes = [a for i, a in enumerate(own) if i == 0 or a != own[i - 1]]
        got = sorted((r for r in chain if r.observed_on.day == day), key=lambda r: r.revision_no)
        assert [str(int(r.average)) for r in got] == changes and [r.is_current for r in got] == [False] * (len(got) - 1) + [True]


def test_files_revise_each_other_and_conflict_only_within_one(spark):
    stored, _, _ = run(spark, spark.createDataFrame([], TABLES["price_observations"]), [(1, "10.00", "a"), (2, "20.00", "a")])
    rows = batch(spark, [(1, "10.00", "b"), (1, "11.00", "c"), (2, "21.00", "c"), (2, "22.00", "c"), (1, "11.00", "d"), (3, "5.00", "d"), (1, "12.00", "e")])
    rows = rows.withColumn("file_seq", F.ascii("source_file_sha256"))
    up = state.upsert_files(stored, rows, now=F.lit("2026-08-02").cast("timestamp"))
    got = {r.observed_on.day: (str(r.average), r.revision_no, r.source_file_sha256) for r in up.state.collect()}
    assert got == {1: ("12.00", 2, "e"), 2: ("20.00", 0, "a"), 3: ("5.00", 0, "d")}
    assert sorted((r.revision_no, str(r.average), r.source_file_sha256) for r in up.revisions.collect()) == [(0, "10.00", "a"), (1, "11.00", "c")]
    assert up.outcome.first().asDict() == dict(inserted=1, revised=2, unchanged=2, conflicts=1, rejected=2)


def test_invalid_rows_are_told_apart(spark):
    from marketloom.schemas import MONEY

    df = spark.createDataFrame([(1, 5.0, 4.0, False), (2, 5.0, 5.0, True), (3, None, None, True), (4, 1.0, 2.0, False)], "id int, low double, high double, unavailable boolean")
    df = df.selectExpr("id", *[f"cast({a} as {MONEY}) as {b}" for a, b in (("low", "low"), ("high", "high"), ("high", "prevailing"), ("low", "average"))], "unavailable")
    good, bad = state.valid(df)
    assert {r.id for r in good.collect()} == {3, 4} and {r.id: r.invalid_reason for r in bad.collect()} == {1: "low 5.00 is above high 4.00", 2: "unavailable with prices"}
