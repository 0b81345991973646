"""Outliers of a series by leave-one-out rolling median and median absolute deviation.

Each series is one array in date order, and a point looks at slices of it: one shuffle by series, and all arithmetic stays in the JVM.
A series has a point for each day and source, so the calendar bounds its array (some 36,500 points in a century, a few MB). Series without such a
bound go in chunks: points are numbered by counts of ranges of days and by their place within a range, and each chunk of numbers is an array
of its own, with as many neighbours on both sides as a window may reach. Results are the same.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RobustConfig
from . import pages

# What makes a spread comparable to a standard deviation.
OF_MEDIAN_DEVIATION = 0.6745
OF_MEAN_DEVIATION = 1.253314
#: Days whose points are numbered together.
RANGE_DAYS = 1024


def impossible_reason() -> Column:
    """Why low, high and average cannot all hold; null if they can."""
    text = {c: F.col(c).cast("decimal(12,2)").cast("string") for c in ("low", "high", "average")}
    return (
        F.when(F.col("low") > F.col("high"), F.concat(F.lit("low "), text["low"], F.lit(" is above high "), text["high"]))
        .when(F.col("average") < F.col("low"), F.concat(F.lit("average "), text["average"], F.lit(" is below low "), text["low"]))
        .when(F.col("average") > F.col("high"), F.concat(F.lit("average "), text["average"], F.lit(" is above high "), text["high"]))
    )


def _middle(sorted_values: str) -> str:
    return f"(({sorted_values}[int((size({sorted_values}) - 1) div 2)] + {sorted_values}[int(size({sorted_values}) div 2)]) / 2)"


def _whole(observations: DataFrame, keys: tuple[str, ...], rest: list[str]) -> DataFrame:
    """A row a series: its points, how many there are, and the number of the first."""
    series = observations.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("_s"))
    return series.withColumns({"_n": F.size("_s"), "_from": F.lit(0), "_own": F.lit(0), "_end": F.size("_s")})


def _chunks(observations: DataFrame, keys: tuple[str, ...], rest: list[str], chunk: int, halo: int) -> DataFrame:
    """A row for each ``chunk`` points of a series, with ``halo`` more on both sides: the points, how many the series has, the number of the first, and its own ones."""
    ranged = observations.withColumn("_range", F.floor(F.coalesce(F.unix_date("observed_on"), F.lit(-(1 << 30))) / RANGE_DAYS))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy(*keys))}).drop("_c")
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*rest))
    counts = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of_range"), "_before", "_n")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_range") == F.col("_of_range"))
    numbered = ranged.withColumn("_k", place).join(counts, same).withColumn("_i", F.col("_before") + F.col("_k") - 1)
    own = F.expr(f"_i div {chunk}")
    near = F.filter(F.array(own - 1, own, own + 1), lambda c: (F.col("_i") >= c * chunk - halo) & (F.col("_i") < (c + 1) * chunk + halo) & (c >= 0) & (c * chunk < F.col("_n")))
    rows = numbered.select(*keys, "_n", "_i", F.struct(*rest).alias("_p"), F.explode(near).alias("_c"))
    parts = rows.groupBy(*keys, "_c").agg(F.sort_array(F.collect_list(F.struct("_i", "_p"))).alias("_x"), F.max("_n").cast("int").alias("_n"), F.min("_i").cast("int").alias("_from"))
    return parts.select(*keys, F.col("_x._p").alias("_s"), "_n", "_from", F.expr(f"int(_c * {chunk})").alias("_own"), F.expr(f"int((_c + 1) * {chunk})").alias("_end"))


def flag_series(observations: DataFrame, config: RobustConfig = RobustConfig(), keys: tuple[str, ...] = ("commodity", "market"), chunk: int | None = None) -> DataFrame:
    """observations with score, is_anomaly, is_impossible and reason. Score is +infinity where all neighbours agree on another value.

    The window counts observations, blank ones included, and slides inwards at the ends of a series. chunk: points of a series in one row, at least a
    window; by default all of them. A blank date counts as the earliest.
    """
    w, reach = config.window, config.window // 2
    if chunk is not None and chunk < w:
        raise ValueError(f"a chunk must hold a window of {w}, got {chunk}")
    rest = ["observed_on", *[c for c in observations.columns if c not in (*keys, "observed_on")]]
    series = _whole(observations, keys, rest) if chunk is None else _chunks(observations, keys, rest, chunk, w)
    series = series.withColumn("_v", F.expr("transform(_s, x -> double(x.average))"))
    # The first and the end of a point's window: what it lacks at one end it takes at the other.
    i = "(j + _from)"
    edges = f"transform(array(struct(greatest(0, {i} - {reach}) as a, least(_n, {i} + {reach} + 1) as b)), z -> if(z.b - z.a >= {w}, z, if(z.a > 0, struct(greatest(0, z.b - {w}) as a, z.b as b), struct(z.a as a, least(_n, {w}) as b))))"
    near = f"transform({edges}, z -> sort_array(array_compact(concat(slice(_v, z.a - _from + 1, {i} - z.a), slice(_v, j + 2, z.b - {i} - 1)))))[0]"
    # One expression with each step bound once: as stacked columns, a filter above would multiply them while planning.
    steps = [
        f"array(struct(_v[j] as v, {near} as nb))",
        f"x -> struct(x.v as v, x.nb as nb, if(size(x.nb) > 0, {_middle('x.nb')}, null) as c)",
        "x -> struct(x.v as v, x.c as c, size(x.nb) as k, sort_array(transform(x.nb, y -> abs(y - x.c))) as d)",
        f"x -> struct(x.v as v, x.c as c, x.k as k, if(x.k > 0, {_middle('x.d')}, null) as mad, if(x.k > 0, aggregate(x.d, 0D, (a, y) -> a + y) / x.k, null) as mean)",
        f"x -> struct(x.v as v, x.c as c, x.k as k, case when x.mad > 0 then x.mad / {OF_MEDIAN_DEVIATION}D when x.mean > 0 then x.mean * {OF_MEAN_DEVIATION}D end as scale)",
        f"""x -> struct(x.v as v, x.c as c, x.k as k, case when x.v is null or x.k < {config.min_neighbours} then null
            when x.scale is not null then (x.v - x.c) / x.scale when x.v <> x.c then double('inf') end as score)""",
        f"""x -> struct(x.v as v, x.c as c, x.k as k, x.score as score, coalesce(abs(x.score) > {config.threshold}D and
            if(x.c = 0, x.v <> 0, abs(x.v - x.c) / abs(x.c) >= {config.min_relative_deviation}D), false) as anomalous)""",
    ]
    bound = steps[0]
    for step in steps[1:]:
        bound = f"transform({bound}, {step})"
    inlined = series.select(*keys, F.expr(f"inline(filter(transform(_s, (p, j) -> struct(p as _p, if({i} >= _own and {i} < _end, ({bound})[0], null) as _r)), x -> x._r is not null))"))
    points = inlined.select(*[F.col(c) if c in keys else F.col(f"_p.{c}") for c in observations.columns], "_r").withColumn("_why", impossible_reason())
    two = lambda c: F.round(F.col(c).cast("decimal(20,6)"), 2).cast("decimal(20,2)").cast("string")  # noqa: E731  half-up
    text = F.when(
        F.col("_r.score") == float("inf"),
        F.concat(two("_r.v"), F.lit(" differs from "), F.col("_r.k").cast("string"), F.lit(" neighbours all at "), two("_r.c")),
    ).otherwise(
        F.concat(two("_r.v"), F.lit(" is "), F.round(F.abs("_r.score").cast("decimal(20,6)"), 1).cast("decimal(20,1)").cast("string"),
                 F.when(F.col("_r.v") > F.col("_r.c"), " deviations above").otherwise(" deviations below"), F.lit(" the surrounding median of "), two("_r.c"))
    )
    reason = F.coalesce("_why", F.when(F.col("_r.anomalous"), text))
    return points.select(
        *observations.columns, F.col("_r.score").alias("score"), F.col("_r.anomalous").alias("is_anomaly"), F.col("_why").isNotNull().alias("is_impossible"), reason.alias("reason")
    )


def flagged_observations(
    facts: DataFrame, config: RobustConfig = RobustConfig(), commodity: str | None = None, market: int | None = None, region: str | None = None,
    markets: DataFrame | None = None, date_from: dt.date | None = None, date_to: dt.date | None = None,
) -> DataFrame:
    """``flag_series`` of the facts that match, blank ones included. Filters come before the windows: what they leave out is nobody's neighbour, and an empty range of dates has no rows."""
    if date_from and date_to and date_from > date_to:
        return flag_series(facts.filter("false"), config)
    return flag_series(pages.observations(facts, commodity, market, None, date_from, date_to, True, region, markets), config)


def anomalies(flagged: DataFrame, only_flagged: bool = True) -> DataFrame:
    """Rows to show, in order of date and market; an infinite score has no number to show and is null."""
    out = flagged.filter("is_anomaly or is_impossible") if only_flagged else flagged
    return out.withColumn("score", F.when(F.abs("score") != float("inf"), F.col("score"))).orderBy("observed_on", "market", "commodity")
