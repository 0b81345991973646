"""What a collapse and an upsert's counts move, and keys that hold nulls."""

import datetime as dt
import random
import re
from decimal import Decimal as D

from pyspark.sql import functions as F

from marketloom.operators import state

from .test_state import BATCH


def rows(rnd, n):
    out = []
    for i in range(n):
        day, figure = rnd.choice([None, *range(1, 8)]), rnd.choice([None, "10", "10", "10", "11"])
        figures = [D(figure)] * 4 if figure else [None] * 4
        out.append(("s", rnd.randint(1, 4), rnd.choice(["c", "d", None]), day and dt.date(2026, 7, day), *figures, figure is None, f"f{i}", i))
    return out


def test_keys_with_nulls_against_a_plain_model(spark):
    for n in (60, 400):
        given = rows(random.Random(n), n)
        random.Random(1).shuffle(mixed := list(given))
        own = {}
        for r in given:
            own.setdefault(r[:4], []).append(r)
        cut = state.collapse_duplicates(state.quantised(spark.createDataFrame(mixed, BATCH)))
        want, bad = {}, {}
        for key, seen in own.items():
            differ = [i for i, r in enumerate(seen) if r[4:9] != seen[0][4:9]]
            if differ:
                bad[key] = 1 + len(seen) - differ[0]
            else:
                want[key] = seen[0]
        assert {tuple(r)[:4]: tuple(r) for r in cut.settled.collect()} == want and want
        assert {tuple(r)[:4]: r.rows_rejected for r in cut.conflicts.collect()} == bad and any(None in k for k in bad)
        assert cut.counts.first().asDict() == {"rows": n, "disputed": sum(len(own[k]) for k in bad), "conflicts": len(bad)}


def test_counts_move_a_key_once_and_no_provenance(spark, tmp_path):
    spark.createDataFrame(rows(random.Random(2), 300), BATCH).write.parquet(f"file://{tmp_path}/batch")
    batch = spark.read.parquet(f"file://{tmp_path}/batch")
    stored = state.collapse_duplicates(state.quantised(batch)).settled.withColumns({"revision_no": F.lit(0), "ingested_at": F.lit("2024-01-01").cast("timestamp")})
    outcome = state.upsert(stored, batch).outcome
    assert outcome.first().conflicts > 0
    plan = outcome._jdf.queryExecution().executedPlan().toString()
    assert "source_file_sha256" not in plan
    outcome.collect()
    final = outcome._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Keys of the stored rows and of the batch, both together, and disputed keys with the rows of the batch.
    moved = [line for line in final.splitlines() if re.search(r"- Exchange hashpartitioning", line)]
    assert 1 <= len(moved) <= 5
