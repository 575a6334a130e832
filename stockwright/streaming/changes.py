"""Consumers of change records: each is a function of a batch, used by foreachBatch and by batch jobs alike.

A batch may come again: each consumer recomputes from tables or overwrites by key, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from stockwright.operators import votes as V
from stockwright.operators.ordered import Ordered, window_heads
from stockwright.sources.tables import kept

CHANGE = (
    "event_name string, sequence_number string, ts timestamp, "
    "new struct<id:string,part_id:string,retailer_id:string,last_known_price_cents:bigint,last_price_updated_at:timestamp,deleted:boolean>, "
    "old struct<id:string,part_id:string,retailer_id:string,last_known_price_cents:bigint,last_price_updated_at:timestamp,deleted:boolean>"
)


def change_stream(spark: SparkSession, path: str, schema: str = CHANGE, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_consumer(stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):  # noqa: ANN201
    """Starts a consumer; ``once`` works off what is there and ends, else a batch is taken every five seconds."""
    writer = stream.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def split_stale(changes: DataFrame, as_of: Column, age: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Records young enough to be worked on, and the others for the dead-letter table."""
    fresh = F.col("ts") >= as_of - F.expr(f"interval {age}")
    return changes.where(fresh), changes.where(~F.coalesce(fresh, F.lit(False)))


def recount(changed: DataFrame, ballots: DataFrame, stored: DataFrame) -> DataFrame:
    """(entity_id, net_votes) that differ from what is stored, for the entities of a batch: counted anew, never added up."""
    ids = changed.select("entity_id").where("entity_id is not null").distinct()
    fresh = V.tally(V.latest(ballots.join(ids, "entity_id", "left_semi"))).select("entity_id", "net_votes")
    now = ids.join(fresh, "entity_id", "left").select("entity_id", F.coalesce("net_votes", F.lit(0)).alias("net_votes"))
    old = stored.select("entity_id", F.col("net_votes").alias("old"))
    return now.join(old, "entity_id").where("not net_votes <=> old").drop("old")


def lowest_drops(changes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Of each listing in a batch the lowest price that is below the one before, the earliest of equals; large batches are dealt to so many tasks."""
    new, old = F.col("new.last_known_price_cents"), F.col("old.last_known_price_cents")
    fell = changes.where((new >= 0) & (old.isNull() | (new < old)))
    fell = fell.select(F.col("new.id").alias("listing_id"), "new.part_id", "new.retailer_id", new.alias("price_cents"), F.col("new.last_price_updated_at").alias("observed_at"), "sequence_number")
    x = F.min_by(F.struct("part_id", "retailer_id", "price_cents", "observed_at"), F.struct("price_cents", "sequence_number"))
    return (fell.repartition(tasks, "listing_id") if tasks else fell).groupBy("listing_id").agg(x.alias("x")).select("listing_id", "x.*")


def tombstoned(changes: DataFrame) -> DataFrame:
    """Ids that a batch turned from live to deleted, each once."""
    was, is_ = F.coalesce("old.deleted", F.lit(False)), F.coalesce("new.deleted", F.lit(False))
    return changes.where(F.col("new.id").isNotNull() & ~was & is_).select(F.col("new.id").alias("id")).distinct()


def purge_messages(ids: DataFrame, kind: str = "part", version: int = 1) -> DataFrame:
    return ids.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(kind).alias("kind"), F.col("id").alias(f"{kind}_id"))).alias("message"))


def failed_sequences(changes: DataFrame, key: str, readable: Column) -> DataFrame:
    """The sequence numbers to hand back for another try: those of each key with a record that can't be read. Keys don't
    affect each other, records without a key are one group.
    """
    bad = changes.where(~F.coalesce(readable, F.lit(False))).select(F.col(key).alias("_bad")).distinct()
    return changes.join(bad, F.col(key).eqNullSafe(F.col("_bad")), "left_semi").select("sequence_number")


def unwrap(attribute: Column) -> Column:
    """The text of a typed attribute struct<S,N,BOOL,NULL>."""
    return F.coalesce(attribute["S"], attribute["N"], attribute["BOOL"].cast("string"))


def alert_events(prices: DataFrame, alerts: DataFrame) -> DataFrame:
    """(alert_id, price_cents, observed_at, last_fired_at) of prices (part_id, price_cents, observed_at) that active alerts of the part
    (alert_id, part_id, threshold_cents, active, last_fired_at) wait for.
    """
    met = prices.join(alerts.where("active"), "part_id").where("threshold_cents >= price_cents")
    return met.select("alert_id", "price_cents", "observed_at", "last_fired_at")


def fired(events: DataFrame, hours: int = 24) -> DataFrame:
    """(alert_id, price_cents, observed_at) of alerts that fire: an alert is silent for some hours after it last *fired*.

    events (alert_id, price_cents, observed_at), and last_fired_at, when the alert fired before the batch, if that is known; events
    before and within the silence after it fire nothing. Of prices at one time the lowest counts. Attempts that failed shall be left
    out of the events, as they silence nothing. Null alerts and times fire nothing.
    """
    span = hours * 3600 * 1_000_000
    last = F.unix_micros(F.col("last_fired_at").cast("timestamp")) if "last_fired_at" in events.columns else F.lit(None).cast("long")
    t = F.unix_micros(F.col("observed_at").cast("timestamp"))
    rows = events.select(F.col("alert_id").cast("long").alias("alert_id"), F.col("price_cents").cast("long").alias("price_cents"), t.alias("t"), last.alias("last"))
    rows = rows.where("alert_id is not null and t is not null").where(F.col("last").isNull() | (F.col("t") >= F.col("last") + span))
    lowest = kept(rows.groupBy("alert_id", "t").agg(F.min("price_cents").alias("price_cents")))
    out = lowest.join(window_heads(lowest, "alert_id", "t", span), ["alert_id", "t"], "left_semi")
    return out.select("alert_id", "price_cents", F.timestamp_micros("t").alias("observed_at"))


def with_fired(alerts: DataFrame, fires: DataFrame) -> DataFrame:
    """alerts with last_fired_at moved on to their last firing; what the next batch shall start from."""
    last = fires.groupBy("alert_id").agg(F.max("observed_at").alias("_fired"))
    moved = F.greatest("last_fired_at", "_fired").alias("last_fired_at")
    return alerts.join(last, "alert_id", "left").select(*[moved if c == "last_fired_at" else F.col(c) for c in alerts.columns])


def _opened(t: np.ndarray, start: int | None, span: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the rows of each window that begins among sorted times; what lies in the window that began at ``start`` comes first."""
    at = 0 if start is None else int(np.searchsorted(t, start + span))
    if at:
        yield 0, at
    while at < len(t):
        end = int(np.searchsorted(t, t[at] + span))
        yield at, end
        at = end


def fired_stream(events: DataFrame, hours: int = 24) -> DataFrame:
    """As fired, over a stream: when an alert last fired is kept as its state from batch to batch and over restarts.

    The state begins with last_fired_at of the alert's first event. Batches must come in the order of time; an event before the last firing fires nothing. The state of an alert is one number.
    """
    span = hours * 3600 * 1_000_000
    out = "alert_id long, price_cents long, observed_at timestamp"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["t", "price_cents"])
        t, first = rows["t"].to_numpy(), rows["last"].iloc[0]
        start = state.get[0] if state.exists else None if pd.isna(first) else int(first)
        heads = [i for i, _ in _opened(t, start, span) if start is None or t[i] >= start + span]
        if heads or start is not None:
            state.update((int(t[heads[-1]]) if heads else start,))
        some = rows.iloc[heads]
        if heads:
            yield pd.DataFrame({"alert_id": key[0], "price_cents": some["price_cents"], "observed_at": pd.to_datetime(some["t"], unit="us")})

    last = F.unix_micros(F.col("last_fired_at").cast("timestamp")) if "last_fired_at" in events.columns else F.lit(None).cast("long")
    rows = events.select(F.col("alert_id").cast("long"), F.col("price_cents").cast("long"), F.unix_micros(F.col("observed_at").cast("timestamp")).alias("t"), last.alias("last"))
    return rows.where("alert_id is not null and t is not null").groupBy("alert_id").applyInPandasWithState(step, out, "last_fired long", "append", "NoTimeout")


@dataclass(frozen=True)
class LimitClass:
    """Requests of any of the methods (none: all) at or below any of the paths (none: all) but for the exempt ones."""

    name: str
    most: int
    methods: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    exempt: tuple[str, ...] = ()

    def fits(self, method: Column, path: Column) -> Column:
        own = F.rtrim(path, F.lit("/"))
        tests = [F.upper(method).isin(*self.methods)] if self.methods else []
        if self.paths:
            tests.append(reduce(or_, [(own == p) | F.startswith(path, F.lit(p + "/")) for p in self.paths]))
        if self.exempt:
            tests.append(~own.isin(*self.exempt))
        return reduce(and_, tests, F.lit(True))


# The classes of requests, of which the first that fits counts, and what is never counted.
LIMITS = (
    LimitClass("get", 200, methods=("GET",)),
    LimitClass("auth", 10, paths=("/api/auth",), exempt=("/api/auth/refresh", "/api/auth/logout")),
    LimitClass("admin", 30, paths=("/api/admin",)),
    LimitClass("default", 60),
)
FREE_METHODS, FREE_PATHS, FREE_BELOW = ("OPTIONS",), ("/", "/health", "/ready", "/openapi.json"), ("/docs", "/redoc")


def limited_requests(requests: DataFrame, limits: Sequence[LimitClass] = LIMITS) -> DataFrame:
    """The requests (client, method, path, ...) that count, with ``class``, its limit ``most``, and ``key``, the counter they count for."""
    method, path = F.col("method"), F.col("path")
    free = F.upper(method).isin(*FREE_METHODS) | path.isin(*FREE_PATHS) | reduce(or_, [(path == p) | F.startswith(path, F.lit(p + "/")) for p in FREE_BELOW])
    found = F.coalesce(*[F.when(c.fits(method, path), F.struct(F.lit(c.name).alias("class"), F.lit(c.most).cast("long").alias("most"))) for c in limits])
    counted = requests.where(~F.coalesce(free, F.lit(False))).withColumn("_c", found).where("_c is not null")
    return counted.select("*", F.col("_c.class").alias("class"), F.col("_c.most").alias("most"), F.concat_ws("#", "_c.class", "client").alias("key")).drop("_c")


def rate_limited(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """(key, ts, request_id, place, allowed): the place of each request in a window that begins with the key's first request
    after the last window, and whether it is within the key's limit. requests (key, ts, request_id, most); null keys and times don't count.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = kept(requests.select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("request_id").cast("long").alias("request_id"), F.col("most").cast("long").alias("most"), t.alias("t")).where("key is not null and t is not null"))
    heads = window_heads(rows, "key", "t", seconds * 1_000_000)
    both = rows.withColumn("kind", F.lit(1)).unionByName(heads.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    # a head comes just before the requests of its window, and no other head between them
    walk = Ordered(both, ["key", "t", "kind", "request_id"]).numbered("at").adding("head", F.when(F.col("kind") == 0, F.col("at"))).carried("head", "began").frame()
    place = (F.col("at") - F.col("began")).cast("long")
    return walk.where("kind = 1").select("key", "ts", "request_id", place.alias("place"), (place <= F.col("most")).alias("allowed"))


def limited_stream(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """As rate_limited, over a stream in the order of time: a key's state is the start of its window and how many requests it has had.

    When the watermark, a window's length behind the latest request, has passed a key's window, a timer drops its state; a request
    that comes later than that isn't counted.
    """
    span = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches).sort_values(["t", "request_id"])
        t = rows["t"].to_numpy()
        start, n = state.get if state.exists else (None, 0)
        places = np.zeros(len(t), np.int64)
        for a, b in _opened(t, start, span):
            if start is None or t[a] >= start + span:
                start, n = int(t[a]), 0
            places[a:b] = n + 1 + np.arange(b - a)
            n += b - a
        state.update((start, int(n)))
        state.setTimeoutTimestamp((start + span) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "ts": pd.to_datetime(rows["t"], unit="us"), "request_id": rows["request_id"], "place": places, "allowed": places <= rows["most"].to_numpy()})

    t = F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    rows = requests.select("key", F.col("ts").cast("timestamp").alias("ts"), t, F.col("request_id").cast("long"), F.col("most").cast("long")).where("key is not null and t is not null")
    rows = rows.withWatermark("ts", f"{seconds} seconds")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, request_id long, place long, allowed boolean", "start long, n long", "append", "EventTimeTimeout")


def unexpired(df: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    return df.where(F.col(column) > now)
