"""Secrets in text: pattern spans, and weak parts that count only where their counterparts stand near.

Base spans come from three patterns. The weak candidates are parts of a multipart credential that
prove nothing alone: an access identifier, a secret-looking value, an endpoint. Each part is put into
the fixed-length cells its scope touches; parts of one document are joined on (document, cell) and
then by distance, so the join is an equality join on small keys. A weak part is reported only when a
part of another kind lies within the scope.

All is Column and DataFrame work. Positions follow from splitting the text by the pattern: the
lengths of gaps and matches add up to the offsets, in code points, in one pass. Texts are scanned once: the spans, with a number
for each row, are a short table in the shared folder, which the join and the result read.

Cases: null and empty texts have no spans; repeated rows keep one result each, as parts are joined within their row; equal
spans are listed once; very long texts are scanned whole, in time that grows with their length (patterns give nothing back, no list is searched
for each match), so chains of labels, runs of one class and lists of hashes of many MB are no harder than prose; columns of the input but ``text`` stay, null ones as they are, and
those named base or spans are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_or_not, stored

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind -> (pattern, cheap guard that every match implies, group that must be long, its least length)
BASE = {
    "assign": (ASSIGN, r"(?i:passw|secret|token|api_?key)", 2, 12),
    "access": (ACCESS, r"AKIA[A-Z0-9]{14}", 0, 18),
    "hex": (HEX, r"[0-9a-f]{16}", 0, 16),
}
_LABEL, _END = "[a-z0-9-]", r"(?:amazonaws|azure|googleapis|internal)\.[a-z]{2,6}"
#: A host starts where a chain of labels does, and ends with the last of its labels that names a provider. Nothing of it is tried twice: loops over groups give
#: nothing back, so the work is linear and its stack does not grow with the chain.
HOST = rf"(?<!{_LABEL})(?<!{_LABEL}\.){_LABEL}++\.(?:(?:(?!{_END}){_LABEL}++\.)*+(?={_END}){_LABEL}++\.)++[a-z]{{2,6}}"
#: The same matches, as an engine that does not backtrack may look for them.
PLAIN_HOST = rf"{_LABEL}+(?:\.{_LABEL}+)*\.{_END}"
ADDRESS = "https?://[a-z0-9.-]+"
#: Parts that are weak alone. The pattern is delimited, so that each match is a maximal run.
PARTS = {
    "key_id": (r"\b[A-Z][A-Z0-9]{15,31}\b", r"[A-Z][A-Z0-9]{15}", 0, 16),
    "key_value": (r"[A-Za-z0-9+/]{32,}={0,2}", r"[A-Za-z0-9+/]{32}", 0, 32),
    "endpoint": (f"(?i:{ADDRESS}|{HOST})", r"(?i:https?://|amazonaws|azure|googleapis|internal)", 0, 8),
}
KINDS = [*BASE, *PARTS]
#: Matches whose positions are summed up in one list.
CHUNK = 256
#: Two parts of a credential stand at most this many code points apart.
SCOPE = 200


def _sql(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else 'r"' + text.replace('"', r"\x22") + '"'


def spans_of(kind: str, pattern: str, guard: str, group: int, least: int, text: str = "body") -> Column:
    """Array of (start, rank, end) of the matches whose group is long enough; empty without any.

    Where a match starts is the sum of all gaps and matches before it. Sums are taken within chunks of CHUNK matches, and over the chunks,
    so that what a list grown item by item copies stays within a chunk.
    """
    p, rank = _sql(pattern), KINDS.index(kind)
    none = "cast(array() as array<struct<s:int,k:int,e:int>>)"
    steps = f"""filter(zip_with(regexp_extract_all({text}, {p}, 0), zip_with(regexp_extract_all({text}, {p}, {group}),
            split({text}, {p}, -1), (v, gap) -> struct(gap, length(v) as width)), (m, g) -> struct(length(g.gap) as gap, length(m) as n, g.width as width)), x -> x.n is not null)"""
    chunks = f"transform(array({steps}), m -> transform(sequence(0, (size(m) - 1) div {CHUNK}), c -> slice(m, c * {CHUNK} + 1, {CHUNK})))[0]"
    starts = "aggregate(c, array(0), (a, x) -> concat(a, array(element_at(a, -1) + aggregate(x, 0, (b, y) -> b + y.gap + y.n))))"
    walk = f"""aggregate(x, struct(t as at, {none} as found),
        (a, y) -> struct(a.at + y.gap + y.n as at, if(y.width >= {least}, concat(a.found, array(struct(a.at + y.gap as s, {rank} as k, a.at + y.gap + y.n as e))), a.found) as found), a -> a.found)"""
    spans = f"transform(array({chunks}), c -> flatten(zip_with(c, slice({starts}, 1, size(c)), (x, t) -> {walk})))[0]"
    return F.expr(f"if({text} rlike {_sql(guard)}, {spans}, {none})")


def listed(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)))")


def scan(docs: DataFrame) -> DataFrame:
    """``doc`` (a struct of the columns of docs but text, base and spans), ``base`` and ``weak``: sorted arrays of (start, kind, end)."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "base", "spans")] or [F.lit(None).alias("_")])
    out = docs.select(doc.alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    found = {k: spans_of(k, *v) for k, v in (BASE | PARTS).items()}
    return out.select("doc", *[F.sort_array(F.concat(*[found[k] for k in kinds])).alias(name) for name, kinds in (("base", BASE), ("weak", PARTS))])


def linked(scanned: DataFrame, key: str = "row_key", scope: int = SCOPE) -> DataFrame:
    """(key, links): the weak parts, if any, that have a part of another kind within ``scope`` that they do not overlap. key: unique to a row.

    An access span serves as key_id, an assign span as key_value. Parts fall into cells of ``scope``
    code points; one side is copied to its neighbouring cells, so each near pair meets in just one.
    """
    as_part = f"transform(filter(base, x -> x.k < 2), x -> struct(x.s as s, if(x.k = 0, {KINDS.index('key_value')}, {KINDS.index('key_id')}) as k, x.e as e, false as weak))"
    parts = (
        scanned.filter(F.size("weak") > 0)
        .select(key, F.expr(f"concat(transform(weak, x -> struct(x.s as s, x.k as k, x.e as e, true as weak)), {as_part})").alias("parts"))
        .filter("size(array_distinct(transform(parts, x -> x.k))) > 1")
        .select(key, F.explode("parts").alias("p"))
        .select(key, "p.s", "p.k", "p.e", "p.weak")
    )
    own = parts.withColumn("cell", F.expr(f"s div {scope}"))
    # An end lies in its own cell or, for a long part, further on: the other side covers every cell it may meet.
    near = parts.select(
        key, F.col("s").alias("s2"), F.col("k").alias("k2"), F.col("e").alias("e2"), F.col("weak").alias("weak2"),
        F.explode(F.expr(f"sequence(greatest(0, s - {scope}) div {scope} - 1, (e + {scope}) div {scope})")).alias("cell"),
    )
    met = own.join(near, [key, "cell"]).filter(f"k <> k2 and s2 <= e + {scope} and s <= e2 + {scope} and (e <= s2 or e2 <= s)")
    # A pair may meet from one side only when a part is longer than a cell; so both of its parts are taken.
    both = met.select(key, F.explode(F.array(F.struct("s", "k", "e", "weak"), F.struct(F.col("s2").alias("s"), F.col("k2").alias("k"), F.col("e2").alias("e"), F.col("weak2").alias("weak")))).alias("p"))
    return both.filter("p.weak").groupBy(key).agg(F.collect_set(F.struct("p.s", "p.k", "p.e")).alias("links"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs without text, with base spans, and all spans: base ones and the weak parts that are linked."""
    # The number of a row is written down with it, so it is the same for all that read it.
    scanned = stored(scan(docs).withColumn("row_key", F.monotonically_increasing_id()), "scanned")
    links = stored(linked(scanned, "row_key", scope), "linked")
    near = small_or_not(links, links.count(), 500)
    spans = F.when(F.col("links").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "links")))
    return scanned.join(near, "row_key", "left").select("doc.*", "base", spans.alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = {f"n_{k}": F.expr(f"bigint(size(filter(base, x -> x.k = {KINDS.index(k)})))") for k in BASE}
    return found.select(
        "doc_id", *[c.alias(k) for k, c in count.items()],
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )


def _kind_sql(kind: str, pattern: str, guard: str, group: int, least: int) -> str:
    p, g = pattern.replace("'", "''"), guard.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS k, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s
    FROM (SELECT doc_id, regexp_extract_all(body, '{p}') AS ms, regexp_extract_all(body, '{p}', {group}) AS vs, string_split_regex(body, '{p}') AS gs FROM d WHERE regexp_matches(body, '{g}')))
  WHERE length(v) >= {least}"""


def _sql_twin() -> str:
    plain = BASE | PARTS | {"endpoint": (f"(?i:{ADDRESS}|{PLAIN_HOST})", *PARTS["endpoint"][1:])}
    found = " UNION ALL ".join(_kind_sql(k, *v) for k, v in plain.items())
    one = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS body FROM documents), f AS MATERIALIZED ({found}),
p AS (SELECT DISTINCT doc_id, s, e, CASE k WHEN 0 THEN {KINDS.index('key_value')} WHEN 1 THEN {KINDS.index('key_id')} ELSE k END AS k FROM f WHERE k <> 2),
w AS (SELECT * FROM f WHERE k >= {len(BASE)} AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = f.doc_id AND p.k <> f.k AND p.s <= f.e + {SCOPE} AND f.s <= p.e + {SCOPE}
  AND (p.e <= f.s OR f.e <= p.s))),
b AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg({one}, ',' ORDER BY s, k, e) AS t FROM f WHERE k < {len(BASE)} GROUP BY doc_id),
a AS (SELECT doc_id, string_agg({one}, ',' ORDER BY s, k, e) AS t FROM (SELECT * FROM f WHERE k < {len(BASE)} UNION SELECT * FROM w) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b.t, '')) AS base_sha256, coalesce(a.t, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


SQL = _sql_twin()
