"""Build lists: cost roll-ups, progress, lines with their canonical parts, copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def costs(builds: DataFrame, lines: DataFrame, labour: DataFrame, prices: DataFrame) -> DataFrame:
    """Each build with parts and labour cost, null where it has no such lines, and the total.

    prices (part_id, price_cents): lines of parts without a price cost nothing. Lines and labour are summed by build before
    they meet, so that neither multiplies the other.
    """
    parts = lines.join(prices, "part_id", "left").groupBy("build_id").agg(F.sum(F.col("quantity") * F.coalesce("price_cents", F.lit(0))).alias("parts_cents"))
    work = labour.groupBy("build_id").agg(F.sum("cost_cents").alias("labour_cents"))
    total = F.col("base_cents") + F.coalesce("parts_cents", F.lit(0)) + F.coalesce("labour_cents", F.lit(0))
    return builds.join(parts, "build_id", "left").join(work, "build_id", "left").withColumn("total_cents", total)


def progress(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Purchased and remaining cost of each build and the purchased share in percent, halves up."""
    priced = lines.join(prices, "part_id").where("price_cents is not null")
    cost = F.coalesce("quantity", F.lit(1)) * F.col("price_cents")
    got = F.sum(F.when(F.col("purchased"), cost).otherwise(0))
    every = F.sum(cost)
    return priced.groupBy("build_id").agg(got.alias("purchased_cents"), (every - got).alias("remaining_cents"), F.when(every == 0, 0).otherwise(F.floor(got * 100.0 / every + 0.5)).cast("long").alias("progress"))


def effective_lines(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Lines of known parts, each with the canonical part it stands for (itself, if that is gone) and that part's name."""
    own = parts.select(F.col("id").alias("part_id"), "canonical_part_id")
    canon = parts.select(F.col("id").alias("canonical_part_id"), F.col("name").alias("canonical_name"))
    names = parts.select(F.col("id").alias("part_id"), "name")
    known = lines.join(own, "part_id").join(names, "part_id").join(canon, "canonical_part_id", "left")
    found = F.col("canonical_name").isNotNull()
    return known.select(*lines.columns, F.when(found, F.col("canonical_part_id")).otherwise(F.col("part_id")).alias("effective_part_id"), F.coalesce("canonical_name", "name").alias("part_name"))


def by_phase(phases: DataFrame, lines: DataFrame) -> DataFrame:
    """Number and quantity of lines in every phase, empty phases included; lines without a phase come last as unassigned."""
    counted = lines.groupBy("phase").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("quantity"))
    known = phases.join(counted, "phase", "left").select(F.col("label"), F.col("sort_order").cast("long").alias("sort_order"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("quantity", F.lit(0)).alias("quantity"))
    rest = counted.join(phases, "phase", "left_anti").agg(F.sum("n_lines").alias("n_lines"), F.sum("quantity").alias("quantity")).where("n_lines > 0")
    return known.unionByName(rest.select(F.lit("unassigned").alias("label"), F.lit(999999).cast("long").alias("sort_order"), "n_lines", "quantity"))


def copied(lines: DataFrame, build_id: int, new_id: int, phase_map: DataFrame) -> DataFrame:
    """The lines of a copy of a build: phases renamed by (phase, new_phase), nothing purchased."""
    own = lines.where(F.col("build_id") == build_id).join(F.broadcast(phase_map), "phase", "left")
    return own.select(F.lit(new_id).cast("long").alias("build_id"), "part_id", F.col("new_phase").alias("phase"), "quantity", F.lit(False).alias("purchased"))


def next_sort_order(items: DataFrame, order: str = "sort_order") -> DataFrame:
    return items.agg(F.coalesce(F.max(order) + 1, F.lit(0)).cast("long").alias("next_sort_order"))
