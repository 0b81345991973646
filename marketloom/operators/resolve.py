"""Resolution of free-text names: exact lookups, and a reason wherever one fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import alias_key, normalise_place, slugify


def read_seed(spark: SparkSession, path: str, columns: str, nullable: tuple[str, ...] = ()) -> DataFrame:
    """A seed CSV as text; an empty field is null in the columns that may be."""
    df = spark.read.csv(path, header=True, schema=columns, nullValue="\u0000", emptyValue="")
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in nullable})


def dangling(aliases: DataFrame, commodities: DataFrame) -> DataFrame:
    """Aliases that name no commodity; a resolver must not start with any."""
    return aliases.join(commodities.select("canonical_slug"), "canonical_slug", "left_anti")


def load_seed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seed tables of a folder of CSV files; an alias that names no commodity is an error."""
    text = lambda names: ", ".join(f"`{n}` string" for n in names.split())
    seed = {
        "commodities": read_seed(spark, f"{folder}/commodities.csv", text("canonical_slug group name specification unit"), ("specification",)),
        "commodity_aliases": read_seed(spark, f"{folder}/commodity_aliases.csv", text("alias_key canonical_slug")),
        "regions": read_seed(spark, f"{folder}/regions.csv", text("psgc_code name level")),
        "sources": read_seed(spark, f"{folder}/sources.csv", text("slug name base_url licence attribution_text"), ("licence",)),
    }
    refuse_dangling(seed["commodity_aliases"], seed["commodities"])
    return seed


def refuse_dangling(aliases: DataFrame, commodities: DataFrame) -> None:
    """Raise if an alias names no commodity."""
    bad = [r.alias_key for r in dangling(aliases, commodities).select("alias_key").orderBy("alias_key").take(5)]
    if bad:
        raise ValueError(f"aliases without a commodity: {', '.join(bad)}")


def resolution_rate(resolved: DataFrame) -> DataFrame:
    """Rows, and the part of them that found a commodity."""
    return resolved.agg(F.count("*").alias("rows"), F.count_if(F.col("alias_reason").isNull()).alias("resolved")).withColumn("rate", F.when(F.col("rows") > 0, F.col("resolved") / F.col("rows")))


def drift(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """(alias_key, kind): keys on enough rows (half the sheets and one) that no alias has, and aliases on too few. Empty when a seed fits its sheets."""
    need = rows.agg((F.floor(F.countDistinct("sheet") / 2) + 1).alias("need"))
    counted = rows.groupBy(alias_key(F.col("group"), F.col("commodity"), F.col("specification")).alias("alias_key")).agg(F.count("*").alias("n"))
    expected = counted.join(F.broadcast(need), F.col("n") >= F.col("need")).select("alias_key")  # one row
    known = aliases.select("alias_key")
    missing = expected.exceptAll(known.distinct()).withColumn("kind", F.lit("missing"))
    return missing.union(known.distinct().exceptAll(expected).withColumn("kind", F.lit("unattested")))


def resolve_commodities(rows: DataFrame, aliases: DataFrame, commodities: DataFrame) -> DataFrame:
    """rows (group, commodity, specification, unit) with canonical_slug, or with ``alias_reason``. Dimensions are small and broadcast
    by their size."""
    keyed = rows.withColumn("alias_key", alias_key(F.col("group"), F.col("commodity"), F.col("specification")))
    known = aliases.select("alias_key", "canonical_slug").join(commodities.select("canonical_slug", F.col("unit").alias("_unit")), "canonical_slug")
    out = keyed.join(known, "alias_key", "left")
    reason = F.when(F.col("canonical_slug").isNull(), F.concat(F.lit("no alias for '"), F.col("alias_key"), F.lit("'"))).when(
        F.col("unit") != F.col("_unit"),
        F.concat(F.lit("unit '"), F.col("unit"), F.lit("' does not match '"), F.col("_unit"), F.lit("' recorded for '"), F.col("canonical_slug"), F.lit("'")),
    )
    return out.withColumn("alias_reason", reason).withColumn("canonical_slug", F.when(F.col("alias_reason").isNull(), F.col("canonical_slug"))).drop("_unit")


def resolve_provinces(rows: DataFrame, regions: DataFrame, column: str = "province") -> DataFrame:
    """rows with psgc_code of the province, null if none is meant."""
    places = regions.filter("level = 'province'").select(normalise_place(F.col("name")).alias("_place"), "psgc_code")
    return rows.withColumn("_place", normalise_place(F.col(column))).join(places, "_place", "left").drop("_place")


def market_key(region: str, municipality: str, name: str) -> list[Column]:
    """What makes two spellings of a market the same."""
    return [F.col(region).alias("_region"), normalise_place(F.col(municipality)).alias("_municipality"), normalise_place(F.col(name)).alias("_name")]


def new_markets(seen: DataFrame, markets: DataFrame, order: str = "file_seq") -> DataFrame:
    """Markets of ``seen`` (region_psgc_code, municipality, market) not known yet, in the spelling met first, with an id made of their key."""
    key = ["_region", "_municipality", "_name"]
    have = markets.select(*market_key("region_psgc_code", "municipality", "name")).distinct()
    met = seen.select(*market_key("region_psgc_code", "municipality", "market"), "municipality", "market", order)
    first = met.groupBy(*key).agg(F.min_by(F.struct("municipality", F.col("market").alias("name")), order).alias("m"))
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 15), 16, 10).cast("long")
    return first.join(have, key, "left_anti").select(number.alias("id"), F.col("_region").alias("region_psgc_code"), "m.municipality", "m.name")


def with_market(rows: DataFrame, markets: DataFrame) -> DataFrame:
    """rows (psgc_code, municipality, market) with market_id of the market that has the same key; of several the least."""
    known = markets.select(*market_key("region_psgc_code", "municipality", "name"), "id").groupBy("_region", "_municipality", "_name").agg(F.min("id").alias("market_id"))
    keyed = rows.select("*", *market_key("psgc_code", "municipality", "market"))
    return keyed.join(known, ["_region", "_municipality", "_name"], "left").drop("_region", "_municipality", "_name")


def attested(rows: DataFrame) -> DataFrame:
    """Triples on more than half of the sheets, with a unique slug; ``rows`` has group, commodity, specification and sheet."""
    need = rows.agg(F.countDistinct("sheet")).first()[0] // 2 + 1
    triple = ["group", "commodity", "specification"]
    counted = rows.groupBy(*triple).agg(F.countDistinct("sheet").alias("sheets")).filter(F.col("sheets") >= need)
    slug = slugify(F.col("group"), F.col("commodity"), F.col("specification"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy(*triple))
    return counted.withColumn("slug", slug).withColumn("_n", n).withColumn("slug", F.when(F.col("_n") > 1, F.concat("slug", F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col("slug"))).drop("_n")


def seed_changes(dim: DataFrame, seed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind) of a seed against the stored dimension: inserted, updated or unchanged. A second run changes nothing."""
    old = dim.select(key, F.struct(*columns).alias("_old"))
    both = seed.select(key, F.struct(*columns).alias("_new")).join(old, key, "left")
    kind = F.when(F.col("_old").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return both.select(key, kind.alias("kind"))


def seeded(dim: DataFrame, seed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The dimension after its seed: rows of the seed as they are there, others as they were, ids of known keys kept and new ones made of the key."""
    old = dim.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in dim.columns if c != key], F.lit(True).alias("_known"))
    new = seed.select(key, *columns, F.lit(True).alias("_seeded"))
    both = old.join(new, old["_key"] == new[key], "full")
    made = F.conv(F.substring(F.sha2(F.coalesce(key, "_key"), 256), 1, 15), 16, 10).cast("long")
    out = []
    for c in dim.columns:
        if c == key:
            out.append(F.coalesce(key, "_key").alias(c))
        elif c in columns:
            out.append(F.when(F.col("_seeded"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c))
        elif c == "id":
            out.append(F.when(F.col("_known"), F.col("_id")).otherwise(made).alias(c))
        else:
            out.append(F.col(f"_{c}").alias(c))
    return both.select(*out)
