"""Connected components of a link table, by local forests and label spreading with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_or_not, stored

#: Bytes that a row of two numbers takes in a broadcast.
ROW = 64


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of one partition as a forest with the same components: (vertex, least vertex), one row a vertex."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = top(x), top(y)
            if p != q:
                above[max(p, q)] = min(p, q)
    rows = [(x, top(x)) for x in above]
    found = [(x, y) for x, y in rows if x != y]
    yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every v in the links (a, b): label is the least id that links reach from v.

    Every partition first reduces its links to a forest, before a shuffle by vertex and after it, so what
    passes work on is about as large as the set of vertices, however many links there are. Each pass takes the least label among the neighbours (aggregated before the shuffle, so a hub with
    millions of links is one row of each task) and then the label's own label, so that the length of a
    chain halves. Passes end when no label changes; each is a table in the shared folder.
    """
    local = stored(links.select("a", "b"), "links").mapInArrow(_forest, "a long, b long")
    links = local.repartition("a").mapInArrow(_forest, "a long, b long")
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    n = labels.count()
    while True:
        known = small_or_not(labels, n, ROW)
        near = both.join(known, both["b"] == known["v"]).groupBy("a").agg(F.min("label").alias("near"))
        near = small_or_not(near, n, ROW)
        least = labels.join(near, labels["v"] == near["a"]).select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        above = small_or_not(labels.select(F.col("v").alias("up"), F.col("label").alias("above")), n, ROW)
        new = stored(least.join(above, least["label"] == above["up"], "left").select("v", "was", F.least("label", "above").alias("label")), "labels")
        labels = new.select("v", "label")
        if new.filter("label <> was").isEmpty():
            return labels
