"""Listings read through a sorted copy of a table: pages touch the few files whose ranges they lie in, and the copy is checked against its table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockwright.operators.ordered import Ordered


def build_listing(rows: DataFrame, by: Sequence[str], folder: str) -> Listing:
    """Writes rows in the order of ``by``, which ends with an id that makes it total, in ranges, and where each range begins and ends.

    A row whose first key is null isn't listed. A key with many rows lies in several ranges.
    """
    dealt = Ordered(rows.where(F.col(by[0]).isNotNull()), by).rows
    dealt.repartition("part").sortWithinPartitions("part", *by).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows")
    ends = dealt.groupBy("part").agg(F.min(F.struct(*by)).alias("low"), F.max(F.struct(*by)).alias("high"))
    ends.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranges")
    return Listing(rows.sparkSession, folder, by, dealt.schema)


class Listing:
    """A listing that was built before; ``rows`` are all of it, without order. An empty one can't be read without its schema."""

    def __init__(self, spark: SparkSession, folder: str, by: Sequence[str], schema: StructType | None = None):
        self.by = list(by)
        self.rows = (spark.read.schema(schema) if schema else spark.read).parquet(f"{folder}/rows")
        self.ranges = spark.read.parquet(f"{folder}/ranges")

    def page(self, key: Sequence, limit: int, after: Sequence | None = None, forward: bool = True, low=None, high=None) -> DataFrame:  # noqa: ANN001
        """The first rows with the leading values ``key``, behind the position ``after`` (values of the rest of the order), forwards or
        backwards; low and high bound the next column of the order, ends included. One row a range is looked at to choose the files.
        """
        rest = self.by[len(key) :]
        first = [F.col(c) == F.lit(v) for c, v in zip(self.by, key, strict=False)]
        tests = list(first)
        if low is not None:
            tests.append(F.col(rest[0]) >= F.lit(low))
        if high is not None:
            tests.append(F.col(rest[0]) <= F.lit(high))
        if after is not None:
            tests.append(_behind(rest, after, forward))
        # a range is read if its ends leave room for the key and for what bounds the next column
        whole = lambda side, cs: F.struct(*[F.col(f"{side}.{c}") for c in cs])
        lead = self.by[: len(key)]
        asked = F.struct(*[F.lit(v).alias(c) for c, v in zip(lead, key, strict=True)])
        met = (whole("low", lead) <= asked) & (whole("high", lead) >= asked) if lead else F.lit(True)
        bounds = [b for b in (low, after[0] if after is not None and forward else None) if b is not None]
        tops = [b for b in (high, after[0] if after is not None and not forward else None) if b is not None]
        more = [*lead, rest[0]] if rest else lead
        for b in bounds:
            met = met & (whole("high", more) >= F.struct(*[F.lit(v).alias(c) for c, v in zip(more, (*key, b), strict=True)]))
        for b in tops:
            met = met & (whole("low", more) <= F.struct(*[F.lit(v).alias(c) for c, v in zip(more, (*key, b), strict=True)]))
        parts = [r["part"] for r in self.ranges.where(met).select("part").collect()]
        some = self.rows.where(F.col("part").isin(*parts)).where(reduce(and_, tests, F.lit(True))) if parts else self.rows.limit(0)
        return some.drop("part").orderBy(*[F.col(c).asc() if forward else F.col(c).desc() for c in rest]).limit(limit)

    def faults(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, fault) of rows that are ``missing`` from the listing, ``wrongly present`` or ``different`` in it; rows has its columns."""
        columns = [c for c in self.rows.columns if c != "part"]
        due = rows.where(F.col(self.by[0]).isNotNull()).select(F.col(key), F.struct(*[c for c in columns if c != key]).alias("due"))
        held = self.rows.select(F.col(key), F.struct(*[c for c in columns if c != key]).alias("held"))
        both = due.withColumn("_d", F.lit(True)).join(held.withColumn("_h", F.lit(True)), key, "full_outer")
        fault = F.when(F.col("_h").isNull(), "missing").when(F.col("_d").isNull(), "wrongly present").when(~F.col("due").eqNullSafe(F.col("held")), "different")
        return both.select(key, fault.alias("fault")).where("fault is not null")


def _behind(columns: Sequence[str], position: Sequence, forward: bool) -> Column:
    """Whether a row comes behind a position in the order of columns."""
    tests = []
    for i, (c, v) in enumerate(zip(columns, position, strict=True)):
        beyond = F.col(c) > F.lit(v) if forward else F.col(c) < F.lit(v)
        tests.append(reduce(and_, [F.col(x) == F.lit(y) for x, y in zip(columns[:i], position[:i], strict=True)], beyond))
    return reduce(or_, tests)
