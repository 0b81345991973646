"""The trie of conversation prefixes, rolled up by bands of depth.

A conversation is the list of its turns (role, text); here each is first rebuilt from the head of another one. A node of depth d is a
distinct list of the first d rebuilt turns, its members are the conversations that start with it, and its name is its depth and least member.

1. Turns go to ranges of (conversation, turn), so a conversation with a third of all turns is spread over many tasks. Each task numbers
   its rows and takes a polynomial hash of all prefixes, in two residues modulo 2^61 - 1, of the turns' SHA-256 digests; texts do not move. Where a
   range ends within a conversation, number and hash of what came before, a row for each range, are added on. The prefix of a rebuilt
   conversation follows from those of the two that it is made of, without a walk over its turns.
2. Nodes are groups of equal prefixes, combined before the shuffle, so a first turn that all conversations share is one row of each task.
3. Depths are cut into bands of BAND. Within its band, a node goes to its ancestors there only: the nodes of one conversation in a band are
   one row, from which each ancestor gets one sum. The roots of bands are again a tree, BAND times less deep, which is rolled up in the same
   way; then the whole total of each root goes to its ancestors in the band above. So a depth of D takes log D rounds, and no
   row makes more than BAND others.
4. The members that end at a node are sorted by range and packed, up to PACKED of them in a row, before the rows of a node meet, where they go
   through one digest in order; no list of them is held.

Cases: null role and text count as empty; rows without conv_id belong to no conversation and make none; turns are ordered with nulls first,
equal ones by role, then by digest, and rows that repeat are turns of their own; remainders have the sign of what is divided, as in SQL; very long
texts are only digested and counted, within the JVM; other columns are not read, whatever their names; an empty table gives an empty result.
Prefixes are told apart by 122 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, partitions, prepared, stored

PRIME = (1 << 61) - 1
#: Two bases of the hash, drawn by digest.
BASES = tuple(int.from_bytes(hashlib.sha256(b"prefix %d" % i).digest()[:7], "little") + 257 for i in range(2))
BAND = 16
#: The longest head that is taken from another conversation, and how many conversations take it from the same one.
HEAD, FAMILY = 5, 100
#: Members in one packed row.
PACKED = 1 << 14
TURN = "part long, conv_id long, d long, p long, q long, chars long"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn, numbered and hashed as far as this range of them goes."""
    part, last, d, p, q = TaskContext.get().partitionId(), None, 0, 0, 0
    b0, b1 = BASES
    for batch in batches:
        ids, out = column(batch, "conv_id").to_pylist(), []
        for c, digest in zip(ids, column(batch, "digest").to_pylist()):
            if c != last:
                last, d, p, q = c, 0, 0, 0
            d += 1
            p = (p * b0 + int.from_bytes(digest[:8], "little")) % PRIME
            q = (q * b1 + int.from_bytes(digest[8:16], "little")) % PRIME
            out.append((d, p, q))
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in ([part] * len(ids), ids, *zip(*out), column(batch, "chars"))], names=["part", "conv_id", "d", "p", "q", "chars"])


def _on(before: tuple[int, int, int], d: int, p: int, q: int) -> tuple[int, int, int]:
    """Number and hashes of a stretch, after another one."""
    n, p0, q0 = before
    return n + d, (p0 * pow(BASES[0], d, PRIME) + p) % PRIME, (q0 * pow(BASES[1], d, PRIME) + q) % PRIME


def _carried(ranges: list) -> dict[int, tuple[int, int, int, int]]:
    """part -> (conversation, turns before, their hashes), where a range begins within a conversation."""
    out, held = {}, None
    for r in sorted(ranges, key=lambda r: r.part):
        last = (r.last.d, r.last.p, r.last.q)
        if held and held[0] == r.first:
            out[r.part] = held
            if r.last.conv_id == r.first:
                last = _on(held[1:], *last)
        held = (r.last.conv_id, *last)
    return out


def _continued(carried: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv = (column(batch, n).to_numpy() for n in ("part", "conv_id"))
            rest = [column(batch, n).to_numpy().copy() for n in ("d", "p", "q")]
            for at in np.unique(part).tolist():
                if at in carried:
                    for k in np.flatnonzero((part == at) & (conv == carried[at][0])).tolist():
                        for x, y in zip(rest, _on(carried[at][1:], *[int(x[k]) for x in rest])):
                            x[k] = y
            yield pa.record_batch([pa.array(x) for x in (conv, *rest, column(batch, "chars"))], names=["conv_id", "d", "p", "q", "chars"])

    return run


def ordered_prefixes(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """(conv_id, d, p, q, chars): every turn with its number from 1 on, the hashes of all turns up to it and the code points of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    keys = ["conv_id", "turn", "role", "digest"]
    rows = rows.repartitionByRange(ranges or partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys)
    found = stored(rows.mapInArrow(_prefixes, TURN), "turns")
    last = F.max(F.struct("conv_id", "d", "p", "q")).alias("last")
    carried = _carried(found.groupBy("part").agg(F.min("conv_id").alias("first"), last).collect())  # a row a range
    return found.mapInArrow(_continued(carried), "conv_id long, d long, p long, q long, chars long") if carried else found.drop("part")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of prefixes whose first ``cut`` turns are replaced by others: dp and dq are what that adds to the hash of the head."""
    for batch in batches:
        c = {n: column(batch, n) for n in batch.schema.names}
        rows = zip(*(c[n].to_pylist() for n in ("d", "p", "q", "cut", "head", "dp", "dq")))
        out = [(head + d - cut, (p + dp * pow(BASES[0], d - cut, PRIME)) % PRIME, (q + dq * pow(BASES[1], d - cut, PRIME)) % PRIME) if dp or dq else (head + d - cut, p, q) for d, p, q, cut, head, dp, dq in rows]
        if out:
            yield pa.record_batch([c["conv_id"], *[pa.array(x, pa.int64()) for x in zip(*out)], c["chars"], c["size"]], names=["conv_id", "d", "p", "q", "chars", "size"])


def rebuilt_prefixes(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their rebuilt size, prefixes (conv_id, d, p, q, chars, size) of the rebuilt ones).

    A conversation c keeps what follows its first crc32(c) % 6 turns, and gets as many first turns of conversation c - c % 100 before it.
    """
    early = F.sort_array(F.collect_list(F.when(F.col("d") <= HEAD, F.struct("d", "p", "q", "chars")))).alias("early")
    convs = stored(own.groupBy("conv_id").agg(F.max("d").alias("n"), early), "convs")
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("early").alias("base_early"))
    asked = convs.withColumn("cut", F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).withColumn("from", F.expr(f"conv_id - conv_id % {FAMILY}"))
    made = asked.join(base, asked["from"] == base["base"], "left").withColumn("head", F.least("cut", F.coalesce("base_n", F.lit(0))))
    zero = F.lit(0).cast("long")

    def gained(name: str) -> Column:
        new = F.when(F.col("head") > 0, F.get(F.col("base_early"), F.col("head").cast("int") - 1)[name]).otherwise(zero)
        old = F.when(F.col("cut") > 0, F.get(F.col("early"), F.col("cut").cast("int") - 1)[name]).otherwise(zero)
        return F.when(F.col("n") > F.col("cut"), F.pmod(new - old, F.lit(PRIME))).otherwise(zero)

    made = made.withColumns({"size": F.col("head") + F.greatest(F.col("n") - F.col("cut"), zero), "dp": gained("p"), "dq": gained("q")})
    made = stored(made.withColumn("heads", F.expr("slice(coalesce(base_early, array()), 1, cast(head as int))")).select("conv_id", "cut", "head", "size", "dp", "dq", "heads"), "made")
    heads = made.select("conv_id", F.explode("heads").alias("t"), "size").select("conv_id", "t.d", "t.p", "t.q", "t.chars", "size")
    tails = own.join(made.drop("heads"), "conv_id").filter("d > cut").mapInArrow(_moved, "conv_id long, d long, p long, q long, chars long, size long")
    return made.select("conv_id", "size"), stored(heads.unionByName(tails), "prefixes")


def band_totals(tree: DataFrame, depth: int, band: int = BAND) -> DataFrame:
    """(d, node, saved, leaves): the sums over every node's subtree.

    tree: (conv_id, d, node, saved, leaves), a row for every depth from 0 on of a conversation, node being the name of its prefix of that depth; saved and leaves
    are the node's own where it has the name of the conversation, else null. depth: the largest d.
    """
    place = F.struct("d", "node", "saved", "leaves")
    top = (F.col("d") % band == 0) & (F.col("d") > 0)  # a band's root also ends the line of the band above it
    at = F.floor(F.col("d") / band)
    lines = tree.select("conv_id", F.explode(F.when(top, F.array(at - 1, at)).otherwise(F.array(at))).alias("band"), place.alias("x"))
    lines = lines.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list("x")).alias("line")).filter("exists(line, x -> x.saved is not null)")
    lines = stored(lines.withColumn("below", F.expr(f"filter(line, x -> x.d >= (band + 1) * {band})")).withColumn("line", F.expr(f"filter(line, x -> x.d < (band + 1) * {band})")), "lines")

    def after(name: str) -> str:
        return f"aggregate(slice(line, i + 1, size(line)), 0L, (a, y) -> a + coalesce(y.{name}, 0L))"

    each = f"filter(transform(line, (x, i) -> struct(x.d as d, x.node as node, {after('saved')} as saved, {after('leaves')} as leaves, exists(slice(line, i + 1, size(line)), y -> y.saved is not null) as some)), x -> x.some)"
    sums = [F.sum(n).alias(n) for n in ("saved", "leaves")]
    within = lines.select(F.explode(F.expr(each)).alias("x")).select("x.d", "x.node", "x.saved", "x.leaves").groupBy("d", "node").agg(*sums)
    if depth < band:
        return within
    within = stored(within, "within")
    roots = within.filter(f"d % {band} = 0").select(F.col("d").alias("d_"), F.col("node").alias("conv_id"), F.col("saved").alias("own_saved"), F.col("leaves").alias("own_leaves"))
    steps = tree.filter(f"d % {band} = 0").select("conv_id", "d", "node")
    own = (steps["conv_id"] == steps["node"]) & (steps["d"] == roots["d_"]) & (steps["conv_id"] == roots["conv_id"])
    above = steps.join(roots, own, "left").select(steps["conv_id"], F.expr(f"d div {band}").alias("d"), "node", F.col("own_saved").alias("saved"), F.col("own_leaves").alias("leaves"))
    whole = band_totals(stored(above, "roots"), depth // band, band).select(F.col("d").alias("d_"), F.col("node").alias("node_"), F.col("saved").alias("s"), F.col("leaves").alias("l"))
    open_ = lines.filter("exists(below, x -> x.saved is not null)")
    passed = open_.join(whole, (open_["conv_id"] == whole["node_"]) & (open_["band"] + 1 == whole["d_"])).select(F.explode("line").alias("x"), F.col("s").alias("saved"), F.col("l").alias("leaves"))
    return within.unionByName(passed.select("x.d", "x.node", "saved", "leaves")).groupBy("d", "node").agg(*sums)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, node, conv_id) as rows (d, node, first, decimal ids joined by commas)."""
    held: list[int] = []
    key = None
    for batch in batches:
        out = []
        for d, node, c in zip(*(column(batch, n).to_pylist() for n in ("d", "node", "conv_id"))):
            if held and (key != (d, node) or len(held) == PACKED):
                out.append((*key, held[0], ",".join(map(str, held))))
                held = []
            key = (d, node)
            held.append(c)
        yield _ends(out)
    if held:
        yield _ends([(*key, held[0], ",".join(map(str, held)))])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.record_batch([*[pa.array(x, pa.int64()) for x in columns[:3]], pa.array(columns[3], pa.string())], names=["d", "node", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by (d, node, first) as (d, node, digest), one list going through one digest."""
    key, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([sha.hexdigest()])], names=["d", "node", "ends_sha256"])

    for batch in batches:
        for d, node, ids in zip(*(column(batch, n).to_pylist() for n in ("d", "node", "ids"))):
            if key != (d, node):
                if key:
                    yield row()
                key, sha = (d, node), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if key:
        yield row()


def end_digests(ends: DataFrame, ranges: int) -> DataFrame:
    """(d, node, ends_sha256) of the members (conv_id) that end at each node."""
    packed = ends.repartitionByRange(ranges, "d", "node", "conv_id").sortWithinPartitions("d", "node", "conv_id").mapInArrow(_packed, "d long, node long, first long, ids string")
    return packed.repartition(ranges, "d", "node").sortWithinPartitions("d", "node", "first").mapInArrow(_digested, "d long, node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, band: int = BAND, ranges: int | None = None) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    ranges = ranges or partitions(spark)
    convs, prefixes = rebuilt_prefixes(ordered_prefixes(turns, ranges))
    found = stored(prefixes.groupBy("d", "p", "q").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.first("chars").alias("chars")), "nodes")
    steps = stored(prefixes.join(found.select("d", "p", "q", "node"), ["d", "p", "q"]).select("conv_id", "d", "node", (F.col("d") == F.col("size")).alias("last")), "steps")
    root, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not n:
        empty = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return spark.createDataFrame([], empty)
    above = steps.select(F.col("conv_id").alias("node"), (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
    nodes = found.drop("p", "q").join(above, ["d", "node"], "left").withColumn("parent", F.when(F.col("d") == 1, F.lit(root)).otherwise(F.col("parent")))
    top = spark.range(1).select(F.lit(0).cast("long").alias("d"), F.lit(root).alias("node"), F.lit(n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("parent"))
    nodes = stored(nodes.unionByName(top), "parents")
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["d", "node"], "left").fillna(0, ["n_children"]), "nodes")
    own = nodes.select(F.col("d").alias("d_"), F.col("node").alias("node_"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"))
    # A conversation names nodes from some depth on, if any; only these conversations are rows of the tree.
    naming = steps.filter("last and conv_id = node").select("conv_id").union(spark.range(1).select(F.lit(root).alias("conv_id"))).distinct()
    path = steps.select("conv_id", "d", "node").union(convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(root).alias("node"))).join(naming, "conv_id", "left_semi")
    tree = path.join(own, (path["conv_id"] == path["node"]) & (path["d"] == own["d_"]) & (path["node"] == own["node_"]), "left").select("conv_id", "d", "node", "saved", "leaves")
    depth = nodes.agg(F.max("d")).first()[0]
    totals = band_totals(stored(tree, "tree"), depth, band)
    ends = steps.filter("last").select("d", "node", "conv_id").union(convs.filter("size = 0").select(F.lit(0).cast("long").alias("d"), F.lit(root).alias("node"), "conv_id"))
    out = nodes.join(totals, ["d", "node"], "left").join(end_digests(ends, ranges), ["d", "node"], "left")
    return out.select(
        F.col("node").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(prepared(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


#: A checksum by its bits, then every prefix as a list, grouped and held against all its descendants.
SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::UBIGINT, flatten([[(ascii(ch) >> k) & 1 FOR k IN range(8)] FOR ch IN string_split(conv_id::VARCHAR, '')])::UBIGINT[]),
           lambda x, b: xor(xor(x, b) >> 1, (xor(x, b) & 1) * 3988292384)) AS state
  FROM (SELECT DISTINCT conv_id FROM turns)),
heads AS (SELECT conv_id, (xor(state, 4294967295) % 6)::BIGINT AS h, conv_id - conv_id % 100 AS base FROM bits),
rebuilt AS (
  SELECT h.conv_id, t.i, t.said, t.chars FROM heads h JOIN turns t ON t.conv_id = h.base AND t.i <= h.h
  UNION ALL
  SELECT h.conv_id, 1000000 + t.i, t.said, t.chars FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.i > h.h),
lists AS (
  SELECT h.conv_id, coalesce(list({'s': r.said, 'c': r.chars} ORDER BY r.i) FILTER (r.i IS NOT NULL), []) AS line
  FROM heads h LEFT JOIN rebuilt r USING (conv_id) GROUP BY h.conv_id),
prefixes AS (
  SELECT conv_id, d, len(line) AS size, sha256(array_to_string([length(x.s) || ':' || x.s FOR x IN line[1:d]], '|')) AS key,
         CASE WHEN d > 0 THEN sha256(array_to_string([length(x.s) || ':' || x.s FOR x IN line[1:d - 1]], '|')) END AS parent_key, coalesce(line[d].c, 0) AS chars
  FROM (SELECT conv_id, line, unnest(range(len(line) + 1)) AS d FROM lists)),
nodes AS (
  SELECT d, key, any_value(parent_key) AS parent_key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, key),
families AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.parent_key = n.key) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = n.parent_key),
totals AS (
  SELECT a.d, a.key, sum(n.saved) AS saved_tokens, sum((n.n_children = 0)::BIGINT) AS n_leaves
  FROM families n JOIN prefixes a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.key)
SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM families f JOIN totals t USING (d, key)
"""
