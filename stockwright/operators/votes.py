"""Votes: the latest one of each user, tallies, flagged entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(ballots: DataFrame, keys: Sequence[str] = ("entity_id", "user_id"), tie: str = "event_id") -> DataFrame:
    """The last ballot of each user on each entity."""
    x = F.max_by(F.struct("vote_type", "created_at"), F.struct("created_at", tie)).alias("x")
    return ballots.groupBy(*keys).agg(x).select(*keys, "x.vote_type", "x.created_at")


def tally(votes: DataFrame) -> DataFrame:
    """(entity_id, upvotes, downvotes, net_votes); other kinds count for neither, entities without votes have no row."""
    up, down = F.count_if(F.col("vote_type") == "upvote"), F.count_if(F.col("vote_type") == "downvote")
    return votes.groupBy("entity_id").agg(up.alias("upvotes"), down.alias("downvotes"), (up - down).alias("net_votes"))


def summary_for(votes: DataFrame, user_id: int) -> DataFrame:
    """Tallies with the total and the user's own vote, null where there is none."""
    own = votes.where(F.col("user_id") == user_id).select("entity_id", F.col("vote_type").alias("own_vote"))
    return tally(votes).withColumn("total_votes", F.col("upvotes") + F.col("downvotes")).join(own, "entity_id", "left")


def flagged(votes: DataFrame, as_of: str, least: int = 5, ratio: float = 0.3, recent: int = 3, days: int = 7) -> DataFrame:
    """Entities with enough votes of which a share is down, or with enough recent down votes."""
    down = F.col("vote_type") == "downvote"
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    t = votes.groupBy("entity_id").agg(F.count("*").alias("total"), F.count_if(down).alias("downvotes"), F.count_if(down & (F.col("created_at") >= since)).alias("recent_downvotes"))
    t = t.withColumn("down_ratio", F.col("downvotes") / F.col("total"))
    return t.where((F.col("total") >= least) & ((F.col("down_ratio") >= ratio) | (F.col("recent_downvotes") >= recent)))


def top_flagged(votes: DataFrame, entities: DataFrame, k: int, as_of: str) -> DataFrame:
    """The k most flagged first, then their details: entities that are gone leave fewer than k rows."""
    top = flagged(votes, as_of).orderBy(F.desc("down_ratio"), F.desc("recent_downvotes"), "entity_id").limit(k)
    return top.join(entities, "entity_id")


def report_verdicts(asked: DataFrame, entities: DataFrame, pending: DataFrame) -> DataFrame:
    """(report_id, verdict) of reports (report_id, user_id, entity_id) that users ask for: ``not found``, ``own``, ``already reported`` or ``created``.

    entities (entity_id, owner_id), pending (user_id, entity_id). Of several reports of a user on an entity in one batch the one of the
    least id counts, and the others find it pending.
    """
    own = entities.select("entity_id", "owner_id", F.lit(True).alias("_known"))
    held = pending.select("user_id", "entity_id").distinct().withColumn("_held", F.lit(True))
    first = asked.groupBy("user_id", "entity_id").agg(F.min("report_id").alias("_first"))
    df = asked.join(own, "entity_id", "left").join(held, ["user_id", "entity_id"], "left").join(first, ["user_id", "entity_id"], "left")
    verdict = F.when(F.col("_known").isNull(), "not found").when(F.col("owner_id") == F.col("user_id"), "own").when(F.col("_held") | (F.col("report_id") != F.col("_first")), "already reported").otherwise("created")
    return df.select("report_id", verdict.alias("verdict"))
