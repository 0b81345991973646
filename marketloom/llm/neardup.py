"""Near-duplicates by minhash with tensored banding, every link confirmed on full shingle sets.

A document has COLLECTIONS small collections of WIDTH minhashes. Each pair of collections is the key
of one table: 12 collections of two give 66 tables of four hashes from 24 minhashes, where plain
banding would compute 264. Two documents of similarity 0.8 meet in at least one table with probability 0.9999.

Documents with equal shingle sets are one class from the start, whatever their number. Within a
bucket nobody is paired with everybody: each member is a candidate of the bucket's pivot, and every
table has another pivot. Two rounds confirm the candidates that share most tables, where both ends are not yet
connected. Buckets that still hold several components are then compared exactly, so no link between different
sets is left out: families of such buckets of at most FAMILY sets and SHINGLES shingles go to one task each, where one matrix product counts all
intersections; larger ones go bucket by bucket, and buckets above that size in pairs of blocks.

Sets are gathered, and classes linked, by their text; ids are attached at the end.

Every join has its hint by counted rows: Spark takes the size of a table from its files, and an explode's from its input, so that
it would broadcast the rows of all tables, 66 a class, while its classes are under the threshold.

Cases: texts without words link with nothing and are their own component; rows that share a doc_id are
one document of the graph, linked by each of their texts; a row without doc_id takes the component of an equal
set, or null, and is kept; of a group the least doc_id stays; very long texts are read piece by piece; other columns are not
returned by ``near_duplicates``, whatever their names, and all are by ``drop_near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, counted, documents, prepared, small_or_not, stored
from .components import components
from .shingles import minhashes, mixed, shingle_sets

SHINGLE, THRESHOLD = 5, 80
COLLECTIONS, WIDTH = 12, 2
SEEDS = mixed(np.arange(1000, 1000 + COLLECTIONS * WIDTH, dtype=np.uint64))
#: Sets that one task compares with each other, their shingles (8 bytes each), and shingles of one matrix product.
FAMILY, SHINGLES, COLUMNS = 4096, 1 << 22, 2048
#: Bytes that a row of two or three numbers, and one of a class (its digest and two more), takes in a broadcast, as measured.
ROW, CLASS = 64, 128
SIGNED = "doc_id long, n_shingles long, same binary, hashes array<long>"


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for first, sets in shingle_sets(column(batch, "text"), k):
                low = minhashes(sets, SEEDS).reshape(len(sets), COLLECTIONS, WIDTH)
                bands = np.ascontiguousarray(low).view(np.uint64).reshape(len(sets), COLLECTIONS).view(np.int64)
                yield pa.record_batch({
                    "doc_id": ids[first : first + len(sets)],
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "same": pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                    "hashes": pa.ListArray.from_arrays(pa.array(range(0, bands.size + 1, COLLECTIONS), pa.int32()), pa.array(bands.ravel())),
                })

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(column(batch, "text"), k):
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64)
                same = pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary())
                yield pa.record_batch({"same": same, "s": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))})

    return run


def alike(a: str, b: str, threshold: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.expr(f"100 * least({a}, {b}) >= {threshold} * greatest({a}, {b})")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = both.select("a", "b", F.expr("size(array_intersect(sa, sb))").alias("n"), (F.size("sa") + F.size("sb")).alias("total"))
    return shared.filter(f"100 * n >= {threshold} * (total - n)").select("a", "b")


class _Graph:
    """Components so far, as (v, label) for the n vertices that any link has touched."""

    def __init__(self, spark: SparkSession, sets: DataFrame, threshold: int):
        self.sets, self.threshold = sets, threshold
        self.labels, self.n = spark.createDataFrame([], "v long, label long"), 0

    def label(self, df: DataFrame, of: str, name: str) -> DataFrame:
        names = small_or_not(self.labels.select(F.col("v").alias(of), F.col("label").alias(f"{name}_")), self.n, ROW)
        return df.join(names, of, "left").withColumn(name, F.coalesce(f"{name}_", of)).drop(f"{name}_")

    def crossing(self, pairs: DataFrame) -> DataFrame:
        return self.label(self.label(pairs, "a", "ca"), "b", "cb").filter("ca <> cb")

    def add(self, links: DataFrame) -> None:
        """Join the components that confirmed links connect."""
        between = self.crossing(links).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        new = components(between)
        known = small_or_not(self.labels.select("v"), self.n, ROW)
        old = self.labels.select(F.col("v").alias("w"), F.col("label").alias("v"))
        moved = old.join(counted(new, ROW), "v", "left").select(F.col("w").alias("v"), F.coalesce(F.col("label"), F.col("v")).alias("label"))
        fresh = new.join(known, "v", "left_anti")
        self.labels = stored(moved.union(fresh), "components")
        self.n = self.labels.count()

    def settle(self, pairs: DataFrame, rounds: tuple[int, ...] = (1, 4)) -> None:
        """Confirm pairs (a, b, weight): in each round the so many heaviest of every a that cross components."""
        left = stored(self.crossing(pairs).select("a", "b", "weight"), "left")
        most = left.count()
        for few in rounds:
            rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
            chosen = small_or_not(left.withColumn("rank", rank).filter(F.col("rank") <= few).select("a", "b"), most, ROW)
            links = stored(confirmed(chosen, self.sets, self.threshold), "links")
            if not links.isEmpty():
                self.add(links)
            left = self.crossing(left.join(chosen, ["a", "b"], "left_anti")).select("a", "b", "weight")


def _linked(threshold: int):
    """Rows (group, v, c, s) come sorted by group. Links that connect the components c of a group, at most one a member."""

    def links(vs: list[int], cs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        if len(set(cs)) < 2:
            return None
        m, sizes = len(vs), np.array([len(s) for s in sets])
        _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        keep = times[inverse] > 1
        row, col = np.repeat(np.arange(m), sizes)[keep], shared[inverse[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((m, m), np.float32)
        for start in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            a, b = np.searchsorted(col, (start, start + COLUMNS))
            block = np.zeros((m, COLUMNS), np.float32)
            block[row[a:b], col[a:b] - start] = 1
            both += block @ block.T
        c = np.array(cs)
        i, j = np.nonzero(np.triu((100 * both >= threshold * (sizes[:, None] + sizes[None, :] - both)) & (c[:, None] != c[None, :]), 1))
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        found = []
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = top(cs[x]), top(cs[y])
            if p != q:
                above[max(p, q)] = min(p, q)
                found.append((vs[x], vs[y]))
        return pa.record_batch([pa.array(list(x), pa.int64()) for x in zip(*found)], names=["a", "b"]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [])
        for batch in batches:
            s = column(batch, "s")
            at, flat = s.offsets.to_numpy(), s.values.to_numpy()
            for k, (g, v, c) in enumerate(zip(*(column(batch, n).to_pylist() for n in ("group", "v", "c")))):
                if g != group:
                    if held[0] and (out := links(*held)):
                        yield out
                    group, held = g, ([], [], [])
                held[0].append(v)
                held[1].append(c)
                held[2].append(flat[at[k] : at[k + 1]].copy())
        if held[0] and (out := links(*held)):
            yield out

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    given = docs.select("doc_id", "text")
    signed = stored(given.mapInArrow(_signatures(shingle), SIGNED), "signed")
    classes = (
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("same")
        .agg(F.min("doc_id").alias("least"), F.first("n_shingles").cast("int").alias("n"), F.first("hashes").alias("hashes"))
    )
    classes = stored(classes.withColumn("v", F.monotonically_increasing_id()), "classes")  # a number that is written down with its class
    n_classes = classes.count()
    tables = F.array(*[F.xxhash64(F.lit(i), F.lit(j), F.col("hashes")[i], F.col("hashes")[j]) for i, j in combinations(range(COLLECTIONS), 2)])
    rows = classes.select("v", "n", F.explode(tables).alias("key"))
    pivot = F.min(F.struct(F.xxhash64("v", "key").alias("h"), F.col("v").alias("b"), F.col("n").alias("nb"))).alias("pivot")
    buckets = rows.groupBy("key").agg(F.count("*").alias("members"), pivot).filter("members > 1").select("key", "pivot.b", "pivot.nb")
    # Only the members of buckets with company are kept, with their pivot.
    members = stored(rows.join(buckets.hint("shuffle_merge"), "key"), "members")
    pairs = members.filter("v <> b").filter(alike("n", "nb", threshold)).groupBy(F.col("v").alias("a"), "b").agg(F.count("*").alias("weight"))
    met = small_or_not(members.select("v").distinct(), n_classes, ROW)
    touched = stored(classes.join(met, "v", "left_semi").select("v", "same", "least", "n"), "touched")
    n_touched, n_shingles = touched.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    near = small_or_not(touched.drop("n"), n_touched, CLASS)
    texts = given.join(near, given["doc_id"] == near["least"], "left_semi")
    # A row of such an id may have another text, which then is of no class here or of its own.
    sets = stored(texts.mapInArrow(_sets(shingle), "same binary, s array<long>").join(near.select("v", "same"), "same").groupBy("v").agg(F.first("s").alias("s")), "sets")
    # Sets of near-copies make much smaller files than rows.
    graph = _Graph(docs.sparkSession, small_or_not(sets, 1, n_touched * ROW + n_shingles * 8), threshold)
    graph.settle(pairs)
    shared = stored(_shared_ids(signed, small_or_not(classes.select("same", "v"), n_classes, CLASS)), "shared")
    if not shared.isEmpty():
        graph.add(shared)
    links = stored(_rest(graph, members), "links")
    if not links.isEmpty():
        graph.add(links)
    linked = stored(classes.select("v", "least").join(small_or_not(graph.labels.select("v", "label"), graph.n, ROW), "v"), "labels")
    least = small_or_not(linked.groupBy("label").agg(F.min("least").alias("component")), graph.n, ROW)
    least = small_or_not(linked.select("v", "label").join(least, "label").select("v", "component"), graph.n, ROW)
    found = classes.select("v", "same", "least").join(least, "v", "left").select("same", F.coalesce("component", "least").alias("component"))
    out = signed.select("doc_id", "n_shingles", "same").join(small_or_not(found, n_classes, CLASS), "same", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _shared_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a doc_id."""
    own = signed.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "same").join(classes, "same").select("doc_id", "v")
    several = own.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("most")).filter("a <> most").select("doc_id", "a")
    return own.join(small_or_not(several, signed.count(), ROW), "doc_id").filter("v <> a").select("a", F.col("v").alias("b")).distinct()


def _rest(graph: _Graph, members: DataFrame) -> DataFrame:
    """Links (a, b) between different components that share a bucket, by comparing full sets."""
    labelled = stored(graph.label(members.select("key", "v", "b", "n"), "v", "c"), "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    some = stored(labelled.join(small_or_not(open_keys, labelled.count(), ROW), "key", "left_semi"), "some")
    n_some = some.count()
    family = components(some.filter("v <> b").select(F.col("v").alias("a"), "b"))
    n_family = family.count()
    weights = some.groupBy("v").agg(F.first("n").alias("n"))
    family = small_or_not(family, n_family, ROW).join(weights, "v")
    sized = family.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    family = stored(family.join(small_or_not(sized, n_family, ROW), "label"), "family")
    fits = (F.col("size") <= FAMILY) & (F.col("shingles") <= SHINGLES)
    whole = family.filter(fits).select("v", F.xxhash64("label").alias("group"))
    # A larger family goes bucket by bucket; a bucket above the size is cut into blocks, and each pair of blocks is a group.
    wide = some.join(small_or_not(family.filter(~fits).select("v"), n_family, ROW), "v").select("key", "v", "n")
    half = F.greatest(F.ceil(F.count("*") / (FAMILY // 2)), F.ceil(F.sum("n") / (SHINGLES // 2)))
    blocks = wide.groupBy("key").agg(half.cast("int").alias("blocks"))
    pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = wide.join(small_or_not(blocks, n_some, ROW), "key").select("key", "v", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("own"), pairs)
    parts = cut.select("v", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"))
    rows = graph.label(whole.union(parts), "v", "c").join(graph.sets, "v").select("group", "v", "c", "s")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_linked(graph.threshold), "a long, b long")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one document of each group: the one with the least doc_id."""
    gone = stored(near_duplicates(docs, shingle, threshold).filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    near = counted(gone, ROW)
    return docs.join(near, docs["doc_id"] == near["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(prepared(spark), sf_dir), shingle=4)
