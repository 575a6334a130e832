"""Minimax contiguous sharding, with DataFrame operations only.

Rows that belong together (equal texts) are atomic groups in the order of their least ids. The smallest shard capacity with
which a greedy fill needs no more than the wanted shards is found by a search that narrows many capacities at once, and the
cuts are made where that fill makes them. Running sums are made by range: each range sums its own groups, and only one
number per range comes to the driver.
"""

from __future__ import annotations

import bisect
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockwright.llm.common import saved, shared_dir, table

SHARDS = 24
#: Added to the UTF-8 bytes of a text.
OVERHEAD = 8
#: Capacities that one pass over the cuts tries.
TRIED = 48
#: Running sums that may come to the driver to end the search; more of them cost another round instead.
FETCHED = 200_000


class RunningSums:
    """Groups in order with their running sums of bytes, written to the shared folder in ranges that a lookup reads one of."""

    def __init__(self, groups: DataFrame):
        spark = groups.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{shared_dir(spark)}/sums-{uuid.uuid4()}"
        # the ranges must be fixed before anything is summed over them
        ranged = saved(groups.repartitionByRange(n, "first", "key").withColumn("part", F.spark_partition_id()))
        sums = {r.part: r.b for r in ranged.groupBy("part").agg(F.sum("bytes").alias("b")).collect()}
        self.parts, self.offsets, at = sorted(sums), [], 0
        for p in self.parts:
            self.offsets.append(at)
            at += sums[p]
        self.total = at
        offset = F.element_at(F.create_map(*[F.lit(x) for p, o in zip(self.parts, self.offsets, strict=True) for x in (p, o)]), F.col("part")) if self.parts else F.lit(0)
        order = Window.partitionBy("part").orderBy("first", "key").rowsBetween(Window.unboundedPreceding, 0)
        ranged.withColumn("ends", F.sum("bytes").over(order) + offset).write.partitionBy("part").parquet(path)
        self.table = spark.read.schema("first bigint, key string, bytes bigint, ends bigint, part int").parquet(path)

    def last_end(self, targets: list[int]) -> list[int]:
        """For each target, the largest running sum that doesn't pass it."""
        places = [bisect.bisect_right(self.offsets, t) - 1 for t in targets]
        some = self.table.where(F.col("part").isin(sorted({self.parts[p] for p in places})))
        got = some.agg(*[F.max(F.when(F.col("ends") <= t, F.col("ends"))) for t in targets]).first()
        return [max(self.offsets[p], g or 0) for p, g in zip(places, got, strict=True)]

    def between(self, windows: list[tuple[int, int]]) -> list[int] | None:
        """The running sums in any of the windows, ends included; None if they are more than may be fetched."""
        place = lambda t: bisect.bisect_left(self.offsets, t) - 1
        parts = sorted({self.parts[p] for a, b in windows for p in range(max(0, place(a)), place(b) + 1)})
        inside = reduce(or_, [F.col("ends").between(a, b) for a, b in windows])
        rows = self.table.where(F.col("part").isin(parts) & inside).select("ends").limit(FETCHED + 1).collect()
        return None if len(rows) > FETCHED else [r.ends for r in rows]


def greedy(sums: RunningSums, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity the ends of the first shards that a greedy fill makes; it is feasible if the last end is the total."""
    ends: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        open_ = [k for k, e in enumerate(ends) if not e or e[-1] < sums.total]
        if not open_:
            break
        for k, x in zip(open_, sums.last_end([(ends[k][-1] if ends[k] else 0) + capacities[k] for k in open_]), strict=True):
            ends[k].append(x)
    return ends


def smallest_capacity(sums: RunningSums, largest: int, shards: int) -> list[int]:
    """The ends of the shards under the smallest feasible capacity.

    Each end grows with the capacity, so the fills of an infeasible and a feasible capacity enclose all ends between them.
    Capacities are tried in rounds until so few running sums lie there that the driver can search among those.
    """
    low = max(-(-sums.total // shards), largest)
    high = -(-sums.total // shards) + largest  # always feasible: a closed shard holds over total / shards
    while True:
        step = max(1, -(-(high - low) // TRIED))
        tries = sorted({*range(low, high, step), high})
        filled = greedy(sums, tries, shards)
        k = next(i for i, e in enumerate(filled) if e[-1] == sums.total)
        if k == 0 or tries[k] - tries[k - 1] == 1:
            return filled[k]
        low, high = tries[k - 1] + 1, tries[k]
        under, over = filled[k - 1], filled[k]
        between = sums.between([(x, over[j] if j < len(over) else sums.total) for j, x in enumerate(under)])
        if between is not None:
            break
    between = sorted({*between, sums.total})

    def fill(capacity: int) -> list[int]:
        ends = [0]
        while len(ends) <= shards and ends[-1] < sums.total:
            ends.append(between[bisect.bisect_right(between, ends[-1] + capacity) - 1])
        return ends[1:]

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fill(middle)[-1] == sums.total else (middle + 1, high)
    return fill(high)


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law `bytes`, shards of nearly equal size.

    Rows of equal text share a shard, whatever its size; null texts go with empty ones. Shards follow the order of the groups'
    least ids, slots count from 0 in each shard in that order; rows that repeat an id take consecutive slots in any order.
    With fewer groups than shards, the last shards are empty; an empty table gives no rows. Null ids come first. Ids are numbers,
    or texts of numbers; others are an error.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key"),
    )
    rows = saved(rows)
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes")).select(F.coalesce("first", F.lit(-(2**63))).alias("first"), "key", "bytes")
    groups = saved(groups)
    largest = groups.agg(F.max("bytes")).first()[0]
    law = [F.lit("bytes").alias("law")]
    if largest is None:
        return rows.select("doc_id", "size", "text_crc32", *law, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    sums = RunningSums(groups)
    cuts = smallest_capacity(sums, largest, shards)
    shard = sum([(F.col("ends") > c).cast("int") for c in cuts[:-1]], F.lit(0))
    placed = rows.join(sums.table.select("key", "first", shard.alias("shard")), "key")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # slots: a row's number in its range, after the rows of the same shard in earlier ranges; a hot group spans ranges
    ranged = saved(placed.repartitionByRange(n, "shard", "first", "key", "doc_id", "size", F.xxhash64("doc_id", "key")).withColumn("part", F.spark_partition_id()))
    before: dict[tuple[int, int], int] = {}
    filled: dict[int, int] = {}
    for r in sorted(ranged.groupBy("part", "shard").count().collect()):
        before[r.part, r.shard] = filled.get(r.shard, 0)
        filled[r.shard] = before[r.part, r.shard] + r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x) for (p, s), o in before.items() for x in (p * shards + s, o)]), F.col("part") * shards + F.col("shard"))
    number = F.row_number().over(Window.partitionBy("part", "shard").orderBy("first", "key", "doc_id"))
    return ranged.select("doc_id", "size", "text_crc32", *law, "shard", (number - 1 + offset).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
