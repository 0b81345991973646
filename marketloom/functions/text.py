"""Text rules as Column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import HEADER_LABELS, UNITS

#: What counts as white space inside a cell: the Unicode property and the four separators U+001C to U+001F.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
AMOUNT = r"^[0-9]+(\.[0-9]+)?$"


def collapse(c: Column) -> Column:
    """Words joined by single spaces; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, " "))


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Where folding a code point is more than lower case: those that become one other (from, to), and those that become several."""
    one, several = {}, {}
    for c in map(chr, range(0x110000)):
        if not 0xD800 <= ord(c) < 0xE000 and (folded := c.casefold()) != c:
            (one if len(folded) == 1 else several)[c] = folded
    return "".join(one), "".join(one.values()), several


def casefold(c: Column) -> Column:
    """Text folded for caseless comparison: each code point by the table of its own, whatever stands beside it, so not as ``lower`` does it."""
    source, target, several = _folds()
    one = F.translate(c, source, target)
    longer = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = F.array_join(F.transform(F.regexp_extract_all(one, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(longer, x), x)), "")
    folded = F.when(one.rlike(f"[{''.join(several)}]"), spelt).otherwise(one)
    return F.when(c.rlike(r"\A[\x00-\x7f]*\z"), F.lower(c)).otherwise(folded)


def alias_key(group: Column, name: Column, specification: Column) -> Column:
    """The exact triple by which a commodity is known, folded for caseless comparison."""
    return F.concat_ws(" | ", *[casefold(collapse(c)) for c in (group, name, specification)])


def normalise_place(c: Column) -> Column:
    return F.lower(F.regexp_replace(collapse(c), r"(?i)^province\s+of\s+", ""))


def normalise_unit(c: Column) -> Column:
    """A known spelling's unit; an unknown unit stays as it is written."""
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    text = collapse(c)
    return F.coalesce(F.element_at(known, F.lower(text)), text)


def read_amount(c: Column) -> Column:
    """struct(value decimal(12,2), error string): null for blank cells, an error for what is no single amount."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: collapse(x) != "")
    broken = F.coalesce(F.contains(c, F.lit("\n")), F.lit(False))  # a cell of one line, as most are, is not split
    plain = F.replace(F.when(broken, collapse(F.get(lines, F.lit(0)))).otherwise(collapse(c)), F.lit(","), F.lit(""))
    several = F.when(broken, F.size(lines) > 1).otherwise(F.lit(False))
    blank = F.when(broken, F.size(lines) == 0).otherwise(collapse(c) == "")
    value = F.when(plain.rlike(AMOUNT) & ~several, plain.try_cast("decimal(12,2)"))
    error = (
        F.when(blank, F.lit(None))
        .when(several, F.concat(F.lit("several values in one cell: "), c))
        .when(value.isNull(), F.concat(F.lit("not a number: "), c))
    )
    return F.struct(value.alias("value"), error.alias("error"))


def field_for(label: Column) -> Column:
    """The header field whose label begins with this text, of six characters at least; null if none or several do."""
    key = F.lower(collapse(label))
    fit = {k: F.startswith(F.lit(v.lower()), key) for k, v in HEADER_LABELS.items()}
    times = sum((f.cast("int") for f in fit.values()), F.lit(0))
    return F.when((F.length(key) >= 6) & (times == 1), F.coalesce(*[F.when(f, F.lit(k)) for k, f in fit.items()]))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no fragment, path and query as they are; null unless http or https with a host."""
    whole = r"^(?i)(https?)://([^/?#]+)([^#]*)"
    host = F.regexp_extract(c, whole, 2)
    url = F.concat(F.lower(F.regexp_extract(c, whole, 1)), F.lit("://"), F.lower(host), F.regexp_extract(c, whole, 3))
    return F.when(host != "", url)


def origin_of(c: Column) -> Column:
    return F.regexp_extract(canonical_url(c), r"^(https?://[^/?]+)", 1)


def filename_of(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def slugify(*parts: Column, length: int = 120) -> Column:
    joined = F.lower(F.concat_ws("-", *[collapse(p) for p in parts]))
    return F.trim(F.substring(F.regexp_replace(joined, "[^a-z0-9]+", "-"), 1, length), F.lit("-"))


def robots_policy(status: Column, has_body: Column) -> Column:
    """What a robots answer means: unreachable (nothing may be fetched), unavailable (all may) or parsed."""
    return (
        F.when(status.isNull() | (status == 429) | (status >= 500), "unreachable")
        .when((status >= 400) & (status < 500), "unavailable")
        .when((status >= 200) & (status < 300) & has_body, "parsed")
        .otherwise("unreachable")
    )


def peso(c: Column) -> Column:
    """An amount as it is shown; a missing one is a dash."""
    return F.coalesce(F.concat(F.lit("₱"), F.format_number(c, 2)), F.lit("—"))


def percent(c: Column) -> Column:
    """A change as it is shown, one place half up, with a sign if it is a rise."""
    shown = F.round(c.cast("decimal(20,6)"), 1).cast("decimal(20,1)").cast("string")
    return F.concat(F.when(c > 0, "+").otherwise(""), shown, F.lit("%"))


def short_date(c: Column) -> Column:
    return F.date_format(c, "d MMM")


def long_date(c: Column) -> Column:
    return F.date_format(c, "d MMMM yyyy")


def days_ago(days: int, today: Column | None = None) -> Column:
    """The date so many days before today, or before a date that stands for it."""
    return F.date_sub(today if today is not None else F.current_date(), days)


def commodity_label(name: Column, specification: Column) -> Column:
    return F.concat(name, F.when(F.coalesce(specification, F.lit("")) != "", F.concat(F.lit(" ("), specification, F.lit(")"))).otherwise(""))
