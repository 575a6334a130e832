"""Price history: windows, extremes, last values, trends and the anchors before a window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from stockwright.operators.ordered import as_of

#: Neighbouring ids that one range of a group's history holds at most.
BLOCK = 1 << 16
#: Rows of a group up to which one task orders them as a whole.
WHOLE = 1 << 18
DAYS = {"7d": 7, "30d": 30, "90d": 90, "180d": 180, "1y": 365, "all": None}


def window_start(name: str, as_of: str) -> Column | None:
    """Where a named window begins; None for all of time, an error for an unknown name."""
    if name not in DAYS:
        raise ValueError(f"unknown window {name!r}; known are {', '.join(DAYS)}")
    return None if DAYS[name] is None else F.lit(as_of).cast("timestamp") - F.expr(f"interval {DAYS[name]} days")


def within(history: DataFrame, name: str, as_of: str) -> DataFrame:
    start = window_start(name, as_of)
    return history if start is None else history.where(F.col("observed_at") >= start)


def trend(slope: Column, n: Column, mean: Column) -> Column:
    """Up or down if the fitted line moves over 1 % of the mean from the first to the last observation, else flat."""
    drift = slope * (n - 1)
    least = F.abs(mean) * 0.01
    return F.when((n < 2) | (mean == 0), "flat").when(drift > least, "up").when(drift < -least, "down").otherwise("flat")


def _in_ranges(history: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """history with ``_place``, a row's number from 0 in its range, and the columns of a day and those of a range in it.

    A range is what a group has at one time for BLOCK neighbouring ids of the last tie, so that no group is ordered as a whole: with one
    observation for each group, time and ids, as ``daily`` and ``ingested`` leave them, a range holds at most BLOCK rows.
    """
    rows = history.withColumns({"_day": F.date_trunc("day", "observed_at"), "_block": F.floor(F.col(ties[-1]) / BLOCK)})
    within = ["observed_at", *ties[:-1], "_block"]
    place = F.row_number().over(Window.partitionBy(*keys, "_day", *within).orderBy(ties[-1])) - 1
    return rows.withColumn("_place", place.cast("long")), [*keys, "_day"], within


def _merged(sums: DataFrame, outer: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The sums of ranges, put one behind the other in order, as those of what they make up together."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*outer).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sums.withColumn("s_ip", F.col("s_ip") + before * F.col("s_p"))
    return moved.groupBy(*outer).agg(F.sum("n").alias("n"), F.sum("s_p").alias("s_p"), F.sum("s_ip").alias("s_ip"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("last").alias("last"))


def summary(history: DataFrame, keys: Sequence[str], ties: Sequence[str] = ("retailer_id",), with_trend: bool = True) -> DataFrame:
    """Least, greatest and last price, its time, the number of observations and the trend of each group.

    The line is fitted over the order of the observations, by time and then by ids (``ties``), not over time. Its slope comes from
    sums of prices and of places times prices, made range by range and moved on by how many observations come before a range.
    """
    last = F.max(F.struct("observed_at", *ties, "price_cents")).alias("last")
    if not with_trend:
        sums = history.groupBy(*keys).agg(F.count("*").alias("n"), F.min("price_cents").alias("low"), F.max("price_cents").alias("high"), last)
    else:
        rows, day, within = _in_ranges(history, keys, ties)
        s_ip = F.sum(F.col("_place").cast("double") * F.col("price_cents")).alias("s_ip")
        sums = rows.groupBy(*day, *within).agg(F.count("*").alias("n"), F.sum(F.col("price_cents").cast("double")).alias("s_p"), s_ip, F.min("price_cents").alias("low"), F.max("price_cents").alias("high"), last)
        sums = _merged(_merged(sums, day, within), keys, ["_day"])
    facts = [F.col("low").alias("min_cents"), F.col("high").alias("max_cents"), F.col("last.price_cents").alias("last_cents"), F.col("last.observed_at").alias("last_at"), F.col("n").alias("observations")]
    if with_trend:
        n = F.col("n").cast("double")
        slope = (F.col("s_ip") - (n - 1) / 2 * F.col("s_p")) * 12 / F.nullif(n * (n * n - 1), F.lit(0.0))
        facts.append(trend(slope, F.col("n"), F.col("s_p") / n).alias("trend"))
    return sums.select(*keys, *facts)


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """left joined with right by keys, of which null ones meet too."""
    own = right.withColumnsRenamed({k: f"{k}_key" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_key")) for k in keys])
    return left.join(F.broadcast(own) if small else own, same, how).drop(*[f"{k}_key" for k in keys])


def placed(history: DataFrame, keys: Sequence[str], ties: Sequence[str], whole: int = WHOLE) -> DataFrame:
    """history with ``place``, each row's number from 0 in its group by time and ids, and the group's least and greatest price, ``low`` and ``high``.

    Groups of up to ``whole`` rows are ordered where they are dealt, without another shuffle. Of greater ones rows only meet those of their
    range: what comes before a range in its day, and before a day in its group, is summed up from counts.
    """
    sizes = history.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("price_cents").alias("_low"), F.max("price_cents").alias("_high"))
    marked = _met(history, sizes.where(F.col("_n") > whole), keys, "left", small=True)  # great groups are few: one of ``whole`` rows at most
    group = Window.partitionBy(*keys)
    # bounds of great groups, null here, are named so that both sides read the same columns of one shuffle
    low, high = F.coalesce("_low", F.min("price_cents").over(group)), F.coalesce("_high", F.max("price_cents").over(group))
    place = F.row_number().over(group.orderBy("observed_at", *ties)).cast("long") - 1
    small = marked.where("_n is null").select(*history.columns, place.alias("place"), low.alias("low"), high.alias("high"))

    rows, day, within = _in_ranges(marked.where("_n is not null").select(*history.columns, F.col("_low").alias("low"), F.col("_high").alias("high")), keys, ties)
    before = lambda outer, order: F.coalesce(F.sum("n").over(Window.partitionBy(*outer).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(*day, *within).agg(F.count("*").alias("n"))
    days = counts.groupBy(*day).agg(F.sum("n").alias("n")).select(*day, before(keys, ["_day"]).alias("_earlier"))
    ranges = counts.select(*day, *within, before(day, within).alias("_before"))
    out = _met(_met(rows, ranges, [*day, *within]), days, day).withColumn("place", F.col("_place") + F.col("_before") + F.col("_earlier"))
    return small.unionByName(out.select(*history.columns, "place", "low", "high"))


def batch_summary(requested: DataFrame, parts: DataFrame, history: DataFrame) -> DataFrame:
    """One row for each requested part_id: the summary over all parts linked to the same canonical part.

    An unknown part or one without observations has nulls, no observations and a flat trend.
    """
    group = parts.select(F.col("id").alias("part_id"), F.coalesce("canonical_part_id", "id").alias("group_id"))
    asked = requested.join(group, "part_id", "left")
    wanted = group.join(asked.select("group_id").distinct(), "group_id", "left_semi")  # before the history is touched
    facts = summary(history.join(wanted, "part_id"), ["group_id"], ["part_id", "retailer_id"])
    return asked.join(facts, "group_id", "left").select(
        "part_id", "min_cents", "max_cents", "last_cents", "last_at", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("trend", F.lit("flat")).alias("trend"),
    )


def anchors(history: DataFrame, start: Column, keys: Sequence[str] = ("part_id", "retailer_id")) -> DataFrame:
    """The last observation of each group strictly before a time."""
    last = F.max(F.struct("observed_at", "price_cents")).alias("x")
    return history.where(F.col("observed_at") < start).groupBy(*keys).agg(last).select(*keys, F.col("x.observed_at").alias("anchor_at"), F.col("x.price_cents").alias("anchor_cents"))


def anchors_of(wanted: DataFrame, history: DataFrame, keys: Sequence[str] = ("part_id", "retailer_id"), start: str = "start") -> DataFrame:
    """wanted with (anchor_at, anchor_cents), the last observation of its keys strictly before its own ``start``; null if there is none."""
    seen = history.select(*keys, F.col("observed_at").alias("anchor_at"), F.col("price_cents").alias("anchor_cents"))
    return as_of(wanted, seen, keys, start, "anchor_at", ["anchor_at", "anchor_cents"], tie="anchor_cents", strict=True)


def anchors_of_windows(history: DataFrame, keys: Sequence[str] = ("part_id", "retailer_id"), of: Sequence[str] = ("part_id",)) -> DataFrame:
    """(keys, name, start, anchor_at, anchor_cents): for each group and named window its anchor, null if there is none; windows end with
    the last observation of the columns ``of``, which are among the keys.

    All windows are found in one grouping of the history, which is dealt anew for neither of them.
    """
    days = {n: d for n, d in DAYS.items() if d}
    ends = history.groupBy(*of).agg(F.max("observed_at").alias("_end"))
    start = {n: F.col("_end") - F.make_dt_interval(F.lit(d)) for n, d in days.items()}
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])  # a null key equals none
    before = [F.max(F.when(known & (F.col("observed_at") < start[n]), F.struct("observed_at", "price_cents"))).alias(f"_{n}") for n in days]
    found = history.join(ends, [*of]).groupBy(*keys, "_end").agg(*before)
    windows = [F.struct(F.lit(n).alias("name"), start[n].alias("start"), F.col(f"_{n}.observed_at").alias("anchor_at"), F.col(f"_{n}.price_cents").alias("anchor_cents")) for n in days]
    return found.select(*keys, F.inline(F.array(*windows)))


def carried_in(history: DataFrame, start: Column, keys: Sequence[str] = ("part_id", "retailer_id")) -> DataFrame:
    """(keys, observed_at, price_cents, seen_at): the point that a window's line begins with, the last price before the window.

    It is placed at the start of the window, or of its day if that is later, and left out where the first observation in the window is the
    same point.
    """
    inside, before = history.where(F.col("observed_at") >= start), history.where(F.col("observed_at") < start)
    first = inside.groupBy(*keys).agg(F.min(F.struct(F.date_trunc("day", "observed_at").alias("day"), "price_cents")).alias("first"))
    last = before.groupBy(*keys).agg(F.max(F.struct("observed_at", "price_cents")).alias("last"))
    at = F.greatest(start, F.date_trunc("day", "last.observed_at"))
    same = (F.col("first.day") == at) & (F.col("first.price_cents") == F.col("last.price_cents"))
    kept_ = last.join(first, [*keys], "left").where(~F.coalesce(same, F.lit(False)))
    return kept_.select(*keys, at.alias("observed_at"), F.col("last.price_cents").alias("price_cents"), F.col("last.observed_at").alias("seen_at"))


def best_price(listings: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, best_cents): the least price >= 0 over a part's link group, for every member; null if there is none."""
    group = parts.select("id", F.coalesce("canonical_part_id", "id").alias("group_id"))
    best = listings.join(group, F.col("part_id") == F.col("id")).groupBy("group_id").agg(F.min(F.when(F.col("price_cents") >= 0, F.col("price_cents"))).alias("best_cents"))
    return group.join(best, "group_id", "left").select("id", "best_cents")


def best_listing(listings: DataFrame) -> DataFrame:
    """The cheapest listing of each part, of equals the one with the least retailer id."""
    x = F.min(F.struct("price_cents", "retailer_id")).alias("x")
    return listings.where("price_cents is not null").groupBy("part_id").agg(x).select("part_id", F.col("x.retailer_id").alias("retailer_id"), F.col("x.price_cents").alias("price_cents"))


def daily(observations: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """One observation for each key and day: what arrived last."""
    day = F.date_trunc("day", "observed_at")
    x = F.max_by(F.struct("price_cents", "observed_at"), F.col(arrival)).alias("x")
    return observations.groupBy(*keys, day.alias("day")).agg(x).select(*keys, "day", "x.price_cents", "x.observed_at")


def ingested(listings: DataFrame, history: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings and history after a batch of observations (part_id, retailer_id, price_cents, observed_at).

    An unknown listing is created. A price of 0 or more becomes the listing's, the latest of the batch counts, and replaces
    the observation of the same day; without one nothing but the listing is written.
    """
    keys = ["part_id", "retailer_id"]
    priced = observations.where("price_cents >= 0")
    seen = observations.groupBy(*keys).agg(F.max(F.when(F.col("price_cents") >= 0, F.struct("observed_at", "price_cents"))).alias("x"))
    both = listings.join(seen, keys, "full_outer")
    new = both.select(*keys, F.coalesce("x.price_cents", "price_cents").alias("price_cents"), F.coalesce("x.observed_at", "updated_at").alias("updated_at"))
    day = F.date_trunc("day", "observed_at").alias("day")
    latest = priced.groupBy(*keys, day).agg(F.max(F.struct("observed_at", "price_cents")).alias("x")).select(*keys, "day", "x.observed_at", "x.price_cents")
    kept = history.select("*", day).join(latest, [*keys, "day"], "left_anti")
    return new, kept.select(*keys, "observed_at", "price_cents").unionByName(latest.select(*keys, "observed_at", "price_cents"))


def chart_groups(points: DataFrame, near: float = 16.0) -> DataFrame:
    """(chart, x, y, head_x, head_y): to which group each pixel of a chart belongs, whose points are drawn as one.

    points (chart, x, y, place), in pixels and in the order in which they are drawn. A point joins the first group whose
    first point is at most ``near`` away, else it begins one. Points of one pixel share a group, so a chart has one element a
    pixel, however long its history, and its groups, of which there are few on a screen, are found in one fold over them.
    """
    pixels = points.groupBy("chart", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).agg(F.min("place").alias("place"))
    drawn = F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    pixel = pixels.select(F.struct("x", "y").alias("p")).schema["p"].dataType
    close = lambda h, p: (h["x"] - p["x"]) * (h["x"] - p["x"]) + (h["y"] - p["y"]) * (h["y"] - p["y"]) <= near * near
    heads = F.aggregate("drawn", F.array().cast(ArrayType(pixel)), lambda hs, p: F.when(F.exists(hs, lambda h: close(h, p)), hs).otherwise(F.array_append(hs, p)))
    charts = pixels.groupBy("chart").agg(drawn.alias("drawn")).select("chart", "drawn", heads.alias("heads"))
    return charts.select("chart", "heads", F.explode("drawn").alias("p")).select(
        "chart", "p.x", "p.y", F.filter("heads", lambda h: close(h, F.col("p")))[0].alias("h"),
    ).select("chart", "x", "y", F.col("h.x").alias("head_x"), F.col("h.y").alias("head_y"))


def drops(history: DataFrame, keys: Sequence[str] = ("part_id", "retailer_id")) -> DataFrame:
    """Observations that are below the one before, or the first of their listing."""
    before = F.lag("price_cents").over(Window.partitionBy(*keys).orderBy("observed_at"))
    changed = history.withColumn("before_cents", before)
    return changed.where("price_cents >= 0 and (before_cents is null or price_cents < before_cents)")


def sparkline(history: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Places from 0 and heights from 0 to 1 in each group; a flat line is at 0.5."""
    y = F.when(F.col("high") == F.col("low"), F.lit(0.5)).otherwise((F.col("price_cents") - F.col("low")) / (F.col("high") - F.col("low")))
    return placed(history, keys, ties).withColumns({"x": F.col("place"), "y": y}).drop("place", "low", "high")


def axis(history: DataFrame) -> DataFrame:
    """Bounds of a price axis: a tenth beyond the extremes, 100 at least, and a step doubled from 1000 for at most 12 ticks."""
    low, high = F.min("price_cents"), F.max("price_cents")
    ends = history.agg(low.alias("low"), high.alias("high")).withColumn("pad", F.greatest(F.floor((F.col("high") - F.col("low")) * 0.1), F.lit(100)))
    ends = ends.select(F.greatest(F.col("low") - F.col("pad"), F.lit(0)).alias("axis_min"), (F.col("high") + F.col("pad")).alias("axis_max"))
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda k: F.lit(1000).cast("long") * F.pow(F.lit(2), k).cast("long")), lambda s: (F.col("axis_max") - F.col("axis_min")) / s <= 12)
    return ends.withColumn("step", F.get(steps, F.lit(0)))


def migrated(parts: DataFrame, fits: DataFrame, listings: DataFrame, net_votes: DataFrame) -> DataFrame:
    """parts with what relational rows leave to joins: car_ids in order (fits: part_id, car_id), the best price of the link group, net votes."""
    cars = fits.groupBy(F.col("part_id").alias("id")).agg(F.sort_array(F.collect_set("car_id")).alias("car_ids"))
    none = F.array().cast(cars.schema["car_ids"].dataType)
    df = parts.join(cars, "id", "left").join(best_price(listings, parts), "id", "left").join(net_votes.select("id", "net_votes"), "id", "left")
    return df.select(*parts.columns, F.coalesce("car_ids", none).alias("car_ids"), F.col("best_cents").alias("best_price_cents"), F.coalesce("net_votes", F.lit(0)).alias("net_votes"))
