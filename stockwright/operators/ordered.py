"""Walks along a total order, dealt into ranges of it: running numbers, values carried on, as-of joins, windows that the first event opens.

No key has to fit into a task: a key with many rows lies in several ranges, and what one range leaves to the next is one row. Where
rows must be looked at twice, their ranges are written first, as they would be dealt anew otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwright.sources.tables import kept


class Ordered:
    """Rows in the order of ``by`` (all ascending or all descending, nulls before values or after), in numbered ranges."""

    def __init__(self, df: DataFrame, by: Sequence[str], descending: bool = False):
        self.by, self.descending, self.columns = list(by), descending, df.columns
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.ranges = n
        self.rows = kept(df.repartitionByRange(n, *self._order()).withColumn("part", F.spark_partition_id()))

    def _order(self, turned: bool = False) -> list[Column]:
        return [F.desc(c) if self.descending != turned else F.asc(c) for c in self.by]

    def _handed_on(self, ends: DataFrame, name: str, what: Column) -> DataFrame:
        """(part, name) of every range, from what the others left; there are as many rows as ranges."""
        parts = ends.sparkSession.range(self.ranges).select(F.col("id").cast("int").alias("part"))
        return F.broadcast(parts.join(ends, "part", "left").withColumn(name, what).select("part", name))

    def numbered(self, name: str = "at") -> Ordered:
        """Adds the number of each row, from 0."""
        before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = self.rows.join(self._handed_on(self.rows.groupBy("part").count(), "_before", before), "part")
        place = F.row_number().over(Window.partitionBy("part").orderBy(*self._order())) - 1
        return self._with(rows.withColumn(name, place + F.col("_before")).drop("_before"), name)

    def carried(self, value: str, name: str, later: bool = False) -> Ordered:
        """Adds the last value that isn't null up to each row, or, with ``later``, the first one behind it."""
        inside = Window.partitionBy("part").orderBy(*self._order(later)).rowsBetween(Window.unboundedPreceding, -1 if later else 0)
        pick = F.max_by if self.descending == later else F.min_by
        ends = self.rows.where(F.col(value).isNotNull()).groupBy("part").agg(pick(value, F.struct(*self.by)).alias("_end"))
        over = Window.orderBy(F.desc("part") if later else F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)
        rows = self.rows.join(self._handed_on(ends, "_came", F.last("_end", ignorenulls=True).over(over)), "part")
        return self._with(rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_came")).drop("_came"), name)

    def _with(self, rows: DataFrame, name: str) -> Ordered:
        out = object.__new__(Ordered)
        out.by, out.descending, out.ranges, out.rows, out.columns = self.by, self.descending, self.ranges, rows, [*self.columns, name]
        return out

    def adding(self, name: str, column: Column) -> Ordered:
        return self._with(self.rows.withColumn(name, column), name)

    def frame(self) -> DataFrame:
        return self.rows.select(*self.columns)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str], tie: str | None = None, strict: bool = False) -> DataFrame:
    """left with ``values`` of the last row of right with the same keys at or before (``strict``: before) each row's own time.

    Of rows of right at one time the one with the greatest ``tie`` counts. Rows without such a row, with a null key or a null time
    have nulls. Neither side has to have few rows a key.
    """
    kind = F.lit(0 if strict else 1)
    own = F.struct(*[F.col(k) for k in keys], F.struct(*values).alias("v"))
    row_type, value_type = left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType, right.select(own.alias("v")).schema["v"].dataType
    tied = F.col(tie) if tie else F.lit(0)
    tie_type = right.select(tied.alias("t")).schema["t"].dataType
    probes = left.select(*keys, F.col(left_at).alias("_at"), (kind * 2).alias("_kind"), F.lit(None).cast(tie_type).alias("_tie"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(value_type).alias("_value"))
    quotes = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(1).alias("_kind"), tied.alias("_tie"), F.lit(None).cast(row_type).alias("_row"), own.alias("_value"))
    found = Ordered(probes.unionByName(quotes), [*keys, "_at", "_kind", "_tie"]).carried("_value", "_last").frame().where("_row is not null")
    same = F.col("_at").isNotNull()
    for k in keys:
        same = same & (F.col(f"_last.{k}") == F.col(k))
    return found.select("_row.*", *[F.when(same, F.col(f"_last.v.{v}")).alias(v) for v in values])


def window_heads(times: DataFrame, key: str, at: str, micros: int) -> DataFrame:
    """(key, at) of the events that open a window: a key's first event, and then each first event at least ``micros`` after the one that
    opened the last window. ``at`` are microseconds; null keys and times open none.

    Every instant points to the one that would open the next window, found for all at once in one walk. From instants that open one
    for sure, as none came within such a time before them, pointers are followed by doubling: a round marks twice as many windows and
    replaces each pointer by that of its target, so that their number is logarithmic in the windows of the longest stretch without a gap.
    """
    instants = times.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t")).distinct()
    here = F.struct("k", "t")
    none = F.lit(None).cast(instants.select(here.alias("v")).schema["v"].dataType)
    both = instants.select("k", "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("origin"), here.alias("value"))
    both = both.unionByName(instants.select("k", (F.col("t") + micros).alias("t"), F.lit(0).alias("kind"), F.col("t").alias("origin"), none.alias("value")))
    # from late to early: what was met last is the first instant at or after a row's time, what is met next the instant before
    walk = Ordered(both, ["k", "t", "kind"], descending=True).carried("value", "next").carried("value", "previous", later=True).frame()
    opens = ~F.coalesce((F.col("previous.k") == F.col("k")) & (F.col("previous.t") > F.col("t") - micros), F.lit(False))
    seen = kept(walk.select("k", "kind", F.coalesce("origin", "t").alias("t"), F.when(F.col("next.k") == F.col("k"), F.col("next.t")).alias("next"), ((F.col("kind") == 1) & opens).alias("opens")))
    sure = seen.where("opens").select("k", "t")
    pointers = seen.where("kind = 0 and next is not null").select("k", "t", "next").join(sure.withColumnRenamed("t", "next"), ["k", "next"], "left_anti")
    # what nothing points to and doesn't open for sure is never reached
    reached = pointers.select("k", F.col("next").alias("t")).distinct().unionByName(sure)
    pointers = pointers.join(reached, ["k", "t"], "left_semi").select("k", "t", "next")
    state = kept(sure.select("k", "t", F.lit(None).cast("long").alias("next")).unionByName(pointers))
    while True:
        marked, jumps = state.where("next is null"), state.where("next is not null")
        new = marked.select("k", "t").join(jumps, ["k", "t"]).select("k", F.col("next").alias("t"))
        twice = jumps.join(jumps.select("k", F.col("t").alias("next"), F.col("next").alias("far")), ["k", "next"]).select("k", "t", F.col("far").alias("next"))
        if new.isEmpty():
            return marked.select(F.col("k").alias(key), F.col("t").alias(at))
        state = kept(marked.unionByName(new.withColumn("next", F.lit(None).cast("long"))).unionByName(twice))
