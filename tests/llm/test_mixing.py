"""Raking of many cells, of few, and of targets that cannot be met; near duplicates whose ids repeat."""

import pytest
from pyspark.sql import functions as F

from marketloom.llm import common, mixing, neardup

MARGINS = {"lang": {"l0": 0.5, "l1": 0.2, "l2": 0.1, "l3": 0.1, "l4": 0.1}, "topic": {"t0": 0.7, "t1": 0.3}}


def test_many_cells_are_fitted_as_few_are(spark):
    common.prepared(spark)
    few = spark.range(200).select(F.expr("concat('s', id div 10)").alias("m_source"), F.expr("concat('l', id % 5)").alias("m_lang"), F.expr("concat('t', (id div 5) % 2)").alias("m_topic"), F.expr("(id * 7919 % 101 + 1) * 1000").alias("tokens"))
    want = {f"s{i}": (i + 1) / 210 for i in range(20)}
    a = {tuple(r[:3]): r for r in mixing.rake(common.stored(few, "few"), {"source": want, **MARGINS}).collect()}
    # Each source is cut into a thousand of equal parts, with equal parts of its target.
    many = common.stored(few.select(F.explode(F.expr("sequence(0, 999)")).alias("k"), "*").withColumns({"m_source": F.concat_ws("-", "m_source", "k"), "tokens": F.expr("tokens div 1000")}).drop("k").repartition(4), "many")
    assert many.count() == 200_000
    each = {f"{s}-{k}": t / 1000 for s, t in want.items() for k in range(1000)}
    fitted = mixing.rake(many, {"source": each, **MARGINS})
    assert "SinglePartition" not in fitted._jdf.queryExecution().executedPlan().toString()
    b = fitted.groupBy(F.substring_index("m_source", "-", 1).alias("m_source"), "m_lang", "m_topic").agg(F.sum("weight").alias("weight"), F.max("residual").alias("residual")).collect()
    assert len(b) == len(a) == 200
    for r in b:
        assert abs(r.weight / a[tuple(r[:3])].weight - 1) < 1e-6 and r.residual < 1e-9


def test_targets_that_contradict_each_other_are_reported(spark):
    common.prepared(spark)
    rows = [(i, "word " * 10, "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(40)]  # a is en, b is de
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="cannot be met together"):
        out = mixing.mix(docs, {"lang": {"en": 0.9, "de": 0.1}, "source": {"a": 0.2, "b": 0.8}})
    assert out.agg(F.min("residual")).first()[0] > 0.1
    assert mixing.mix(docs, {"lang": {"en": 0.9, "de": 0.1}, "source": {"a": 0.9, "b": 0.1}}).agg(F.max("residual")).first()[0] < 1e-9


def test_rows_that_share_an_id_lose_no_link(spark):
    common.prepared(spark)
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (2, a + " one"), (1, b), (3, b + " one")]

    def found(rows):
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        return sorted((r.doc_id, r.component_id, r.kept) for r in out.collect())

    assert found(rows) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert found([(5, a), (2, a + " one"), (5, b), (4, b + " one"), (9, "other words of its own")]) == [(2, 2, True), (4, 2, False), (5, 2, False), (5, 2, False), (9, 9, True)]
    left = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 1]
