"""Listing pages: anchors, candidate files with dates, duplicates and rejects."""

from __future__ import annotations

import datetime as dt
import html as entities
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import read_date
from ..functions.text import canonical_url, collapse, filename_of, stem_of

#: Everything in a page that is no text: comments, scripts and styles with what they hold, and tags, of which a link's are told apart.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(?P<end>/?)a(?=[\s/>])(?P<inside>(?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-z!?](?:[^>"']|"[^"]*"|'[^']*')*>""",
    re.IGNORECASE | re.DOTALL,
)
HREF = re.compile(r"""(?<![^\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
LINKS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("position", pa.int32()), ("href", pa.string()), ("link_text", pa.string())])


def links_of(html: str) -> list[tuple[str | None, str]]:
    """(href, text) of each link. A link's text goes to the next tag of a link, opening or closing, or to the end of the page."""
    marks = list(MARKUP.finditer(html))
    edges = [i for i, m in enumerate(marks) if m["inside"] is not None]
    found = []
    for i, stop in pairwise([*edges, len(marks)]):
        if marks[i]["end"]:
            continue
        # What stands between the tags up to the edge, in one.
        ends = [m.end() for m in marks[i:stop]]
        starts = [m.start() for m in marks[i + 1 : stop + 1]] + [len(html)] * (stop == len(marks))
        text = "".join(html[a:b] for a, b in zip(ends, starts))
        hrefs = HREF.findall(marks[i]["inside"])
        found.append((entities.unescape("".join(hrefs[-1])) if hrefs else None, " ".join(entities.unescape(text).split())))
    return found


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, href, link_text) of the links of each page (page_id, url, html). Entities are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, u, i, *link) for p, u, h in zip(*(b.column(k).to_pylist() for k in range(3))) for i, link in enumerate(links_of(h or ""))]
            if rows:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows), LINKS)], schema=LINKS)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, position int, href string, link_text string")


def simple_anchors(pages: DataFrame) -> DataFrame:
    """As ``anchors``, for pages whose links hold no markup: no Python, entities left as they are."""
    link = r'(?i)<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)'
    parts = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("text"))
    out = pages.select("page_id", "url", F.posexplode(parts).alias("position", "a"))
    return out.select("page_id", "url", "position", F.col("a.href").alias("href"), collapse(F.col("a.text")).alias("link_text"))


def _dotless(path: Column) -> Column:
    """A path without its . and .. steps; one that ends in such a step ends in a folder."""
    steps = F.split(F.concat(path, F.when(path.rlike(r"(^|/)\.\.?$"), "/").otherwise("")), "/", -1)
    walked = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s))),
        lambda kept: F.concat(F.lit("/"), F.array_join(kept, "/")),
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), walked).otherwise(path)


def absolute(base: str, href: str) -> Column:
    """A link's absolute address, as a Column expression; null where the page's own address is not http(s) and the link needs it."""
    b, h = F.col(base), F.trim(F.col(href))
    root = F.nullif(F.regexp_extract(b, r"(?i)^https?://[^/?#]+", 0), F.lit(""))
    folder = F.regexp_replace(F.regexp_extract(b, r"(?i)^https?://[^/?#]+([^?#]*)", 1), "[^/]*$", "")
    path, rest = F.regexp_extract(h, "^[^?#]*", 0), F.regexp_extract(h, "[?#].*$", 0)
    merged = F.when(path.startswith("/"), path).otherwise(F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), path), "//+", "/"))
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(root, "^[^:]+:", 0), h))
        .when(h.startswith("#"), F.concat(F.regexp_extract(b, "^[^#]*", 0), h))
        .when(h.startswith("?"), F.concat(F.regexp_extract(b, "^[^?#]*", 0), h))
        .otherwise(F.concat(root, _dotless(merged), rest))
    )


def candidates(links: DataFrame, pattern: str) -> DataFrame:
    """links with ``target`` (canonical), the ones that are http(s) and whose address matches the pattern; others are nobody's business."""
    named = links.filter("coalesce(trim(href), '') <> ''").withColumn("address", absolute("url", "href")).filter(F.col("address").rlike(pattern))
    return named.withColumn("target", canonical_url(F.col("address"))).drop("address").filter(F.col("target").isNotNull())


def first_sightings(found: DataFrame) -> DataFrame:
    """Of equal targets the first in page order, and how often it was met."""
    at = F.struct("page_id", "position")
    return found.groupBy("target").agg(F.min_by(F.struct("page_id", "position", "link_text"), at).alias("f"), F.count("*").alias("times")).select("f.*", "target", "times")


def entries(found: DataFrame, not_before: dt.date | None = None, not_after: dt.date | None = None) -> DataFrame:
    """Distinct candidates with date, its source, revision flag and correction, or with ``reason`` for a reject."""
    first = first_sightings(found).withColumn("filename", filename_of(F.col("target")))
    read = first.withColumns({"r1": read_date(F.col("link_text")), "r2": read_date(stem_of(F.col("filename")))})
    used = F.when(F.col("r1.value").isNotNull(), F.col("r1")).otherwise(F.col("r2"))
    both = F.concat(F.lit("no date in link text ("), F.col("r1.reason"), F.lit(") nor in filename ("), F.col("r2.reason"), F.lit(")"))
    reason = F.when(used["value"].isNull(), both)
    if not_before:
        reason = F.coalesce(reason, F.when(used["value"] < F.lit(not_before), F.concat(used["value"].cast("string"), F.lit(f" is before {not_before}"))))
    if not_after:
        reason = F.coalesce(reason, F.when(used["value"] > F.lit(not_after), F.concat(used["value"].cast("string"), F.lit(f" is after {not_after}"))))
    return read.select(
        "page_id", "position", "target", "link_text", "filename", "times", used["value"].alias("observed_on"),
        F.when(F.col("r1.value").isNotNull(), "link_text").when(F.col("r2.value").isNotNull(), "filename").alias("date_source"),
        F.col("filename").rlike(r"(?i)\brevised\b").alias("is_revision"),
        used["corrected"].alias("month_was_corrected"), used["corrected_from"].alias("corrected_from"), reason.alias("reason"),
    )


def counters(judged: DataFrame) -> DataFrame:
    n, bad = F.count("*"), F.count_if(F.col("reason").isNotNull())
    return judged.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("candidates"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("duplicates"),
        (n - bad).alias("entries"), bad.alias("rejected"), F.when(n > 0, bad / n).otherwise(0.0).alias("rejection_rate"),
    )


def lookback(judged: DataFrame, today: dt.date, days: int = 14) -> DataFrame:
    """Entries to reconcile, oldest first, ties in page order, numbered from 1 over all days. Files dated in the future stay in.

    A day's entries are numbered within the day; how many come before it follows from a count a day, so no task has all entries.
    """
    kept = judged.filter(F.col("reason").isNull() & (F.col("observed_on") >= F.lit(today - dt.timedelta(days=days))))
    before = Window.partitionBy().orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    counts = kept.groupBy(F.col("observed_on").alias("day")).agg(F.count("*").alias("n")).select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = kept.withColumn("_k", F.row_number().over(Window.partitionBy("observed_on").orderBy("page_id", "position")))
    out = within.join(counts, within["observed_on"] == counts["day"]).withColumn("file_seq", F.col("before") + F.col("_k"))
    return out.drop("day", "before", "_k").orderBy("file_seq")
