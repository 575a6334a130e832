"""Walks along an order, windows that an event opens, kept state of streams, sums by ranges, each against a plain loop."""

import datetime as dt
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockwright.operators import ordered as W
from stockwright.operators import prices as P
from stockwright.sources import tables
from stockwright.streaming import changes as S

DAY0 = dt.datetime(2024, 1, 1)
AT = lambda hours: DAY0 + dt.timedelta(hours=hours)


def opened(times, span):
    out, last = [], None
    for t in sorted(times):
        if last is None or t >= last + span:
            out.append(t)
            last = t
    return out


@pytest.fixture(scope="module")
def events():
    """One key with most rows, ties, a key of one event and one whose events all open windows."""
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.8 else r.choice("ab"), r.randrange(4000), i) for i in range(700)]
    return rows + [("one", 5, 900)] + [("far", 10_000 * k, 1000 + k) for k in range(9)] + [("hot", 77, 2000), ("hot", 77, 2001)]


@pytest.mark.parametrize("span", (1, 9, 150, 10**7))
def test_window_heads(spark, events, span):
    df = spark.createDataFrame([*events, (None, 5, 1), ("hot", None, 2)], "k string, t long, id long").repartition(5)
    got = W.window_heads(df, "k", "t", span)
    assert got.columns == ["k", "t"]
    want = {(k, t) for k in {e[0] for e in events} for t in opened([e[1] for e in events if e[0] == k], span)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_window_heads_of_nothing(spark):
    assert W.window_heads(spark.createDataFrame([], "k string, t long"), "k", "t", 5).collect() == []


@pytest.mark.parametrize("strict", (False, True))
def test_as_of(spark, events, strict):
    r = random.Random(2)
    quotes = [(r.choice(("hot", "hot", "a")), r.randrange(4000), r.randrange(50)) for _ in range(250)] + [("hot", 77, 99), (None, 3, 1), ("a", None, 1)]
    left = spark.createDataFrame([*events, (None, 50, -1), ("hot", None, -2)], "k string, t long, id long")
    got = {x.id: (x.qt, x.p) for x in W.as_of(left, spark.createDataFrame(quotes, "k string, qt long, p long"), ["k"], "t", "qt", ["qt", "p"], tie="p", strict=strict).collect()}
    want = {-1: (None, None), -2: (None, None)}
    for k, t, i in events:
        seen = [(q, p) for key, q, p in quotes if key == k and q is not None and (q < t if strict else q <= t)]
        want[i] = max(seen, default=(None, None))
    assert got == want


@pytest.mark.parametrize("descending", (False, True))
def test_numbers_and_values_carried_over_ranges(spark, events, descending):
    rows = [(t, i, t if i % 40 == 0 else None) for _, t, i in events]
    df = W.Ordered(spark.createDataFrame(rows, "t long, id long, v long"), ["t", "id"], descending)
    assert df.rows.select("part").distinct().count() > 1
    got = {x.id: (x.at, x.up, x.down) for x in df.numbered().carried("v", "up").carried("v", "down", later=True).frame().collect()}
    order = sorted(rows, reverse=descending)
    for n, (_, i, _) in enumerate(order):
        up = next((v for _, _, v in reversed(order[: n + 1]) if v is not None), None)
        down = next((v for _, _, v in order[n + 1 :] if v is not None), None)
        assert got[i] == (n, up, down)


ALERT_EVENTS = "alert_id long, price_cents long, observed_at timestamp, last_fired_at timestamp"


def alert_rows():
    r = random.Random(4)
    rows = [(1 if r.random() < 0.7 else r.randrange(2, 6), r.randrange(100), AT(r.randrange(0, 24 * 12) + r.random()), None) for _ in range(300)]
    rows += [(9, 5, AT(h), AT(0)) for h in (-3, 5, 23.9, 24, 47, 48)] + [(10, 7, AT(3), None), (10, 4, AT(3), None)]
    return [(a, p, t, f if a == 9 else None) for a, p, t, f in rows]


def fires(rows):
    out = set()
    for a in {x[0] for x in rows}:
        last = AT(0) if a == 9 else None
        for _, p, t, _ in sorted((x for x in rows if x[0] == a), key=lambda x: (x[2], x[1])):
            if last is None or t >= last + dt.timedelta(hours=24):
                out.add((a, p, t))
                last = t
    return out


def test_fired_in_one_batch_and_in_three(spark):
    rows = alert_rows()
    df = spark.createDataFrame([*rows, (None, 1, AT(1), None), (1, 1, None, None)], ALERT_EVENTS)
    assert {tuple(x) for x in S.fired(df).collect()} == fires(rows)
    # the alerts hand on when they last fired
    alerts = tables.kept(spark.createDataFrame([(a, AT(0) if a == 9 else None) for a in range(1, 11)], "alert_id long, last_fired_at timestamp"))
    found = set()
    for k in range(3):
        some = [(a, p, t) for a, p, t, _ in rows if (-10, 100, 200)[k] <= (t - DAY0).total_seconds() / 3600 < (100, 200, 999)[k]]
        batch = spark.createDataFrame(some, "alert_id long, price_cents long, observed_at timestamp").join(alerts, "alert_id")
        got = tables.kept(S.fired(batch))
        found |= {tuple(x) for x in got.collect()}
        alerts = tables.kept(S.with_fired(alerts, got))
    assert found == fires(rows)
    again = S.fired(batch.drop("last_fired_at").join(alerts, "alert_id"))  # the last batch once more
    assert again.collect() == []


def test_alert_events_are_those_of_active_alerts(spark):
    alerts = spark.createDataFrame([(1, 7, 50, True, None), (2, 7, 40, True, None), (3, 7, 99, False, None), (4, 8, 99, None, None), (5, 7, None, True, None)], "alert_id long, part_id long, threshold_cents long, active boolean, last_fired_at timestamp")
    prices = spark.createDataFrame([(7, 45, AT(0)), (7, None, AT(1)), (8, 1, AT(2))], "part_id long, price_cents long, observed_at timestamp")
    assert [(x.alert_id, x.price_cents) for x in S.alert_events(prices, alerts).collect()] == [(1, 45)]


def in_files(spark, path, rows, schema, cuts):
    for a, b in zip(cuts, cuts[1:], strict=False):
        some = [x for x in rows if a <= (x[2] - DAY0).total_seconds() / 3600 < b]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)
        yield


def sink(path):
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def test_stream_keeps_cooldowns_over_a_restart(spark, tmp_path):
    rows, source, out = alert_rows(), str(tmp_path / "in"), str(tmp_path / "out")
    files = in_files(spark, source, rows, ALERT_EVENTS, (-10, 60, 130, 210, 999))
    start = lambda: S.run_consumer(S.fired_stream(S.change_stream(spark, source, ALERT_EVENTS, 1)), sink(out), str(tmp_path / "checkpoint"))
    next(files)
    next(files)
    start().awaitTermination()
    before = spark.read.parquet(out).count()
    next(files)
    assert next(files, None) is None
    start().awaitTermination()
    got = spark.read.parquet(out).select("alert_id", "price_cents", "observed_at")
    assert 0 < before < got.count() and sorted(map(tuple, got.collect())) == sorted(fires(rows))
    start().awaitTermination()
    assert spark.read.parquet(out).count() == len(fires(rows))


def test_stream_keeps_windows_over_a_restart(spark, tmp_path):
    r = random.Random(6)
    rows = sorted({("k" if r.random() < 0.7 else r.choice("ab"), i, AT(r.random() * 40), 4) for i in range(260)}, key=lambda x: x[2])
    schema, source, out = "key string, request_id long, ts timestamp, most long", str(tmp_path / "in"), str(tmp_path / "out")
    files = in_files(spark, source, rows, schema, (0, 9, 21, 40))
    start = lambda: S.run_consumer(S.limited_stream(S.change_stream(spark, source, schema, 1), 7200), sink(out), str(tmp_path / "checkpoint"))
    for _ in files:
        start().awaitTermination()
    got = {x.request_id: (x.place, x.allowed) for x in spark.read.parquet(out).collect()}
    want, state = {}, {}
    for k, i, t, most in rows:
        begun, n = state.get(k, (None, 0))
        begun, n = (t, 0) if begun is None or t >= begun + dt.timedelta(hours=2) else (begun, n)
        state[k] = (begun, n + 1)
        want[i] = (n + 1, n + 1 <= most)
    assert got == want
    batch = {x.request_id: (x.place, x.allowed) for x in S.rate_limited(spark.createDataFrame(rows, schema), 7200).collect()}
    assert batch == want


HISTORY = "part_id long, retailer_id long, observed_at timestamp, price_cents long"


def history_rows():
    r, out = random.Random(8), {}
    for _ in range(900):  # ids far apart, so that a day has several ranges
        out[r.choice((1, 1, 1, 2)), r.randrange(4) * 70_000 + r.randrange(3), AT(24 * r.randrange(12))] = r.randrange(900, 1100)
    out[3, 5, AT(0)] = 7
    out |= {(4, k, AT(24 * k)): 1000 for k in range(3)} | {(5, k, AT(0)): 100 + k for k in range(4)}
    return [(*k, v) for k, v in out.items()]


@pytest.mark.parametrize("keys,ties", [(["part_id"], ["retailer_id"]), (["retailer_id"], ["part_id"])])
def test_places_and_trends_by_ranges(spark, keys, ties):
    rows = history_rows()
    df = spark.createDataFrame(rows, HISTORY)
    k, t = (0, 1) if keys == ["part_id"] else (1, 0)
    groups = defaultdict(list)
    for x in sorted(rows, key=lambda x: (x[2], x[t])):
        groups[x[k]].append(x)
    want = {(x[0], x[1], x[2]): (i, min(y[3] for y in g), max(y[3] for y in g)) for g in groups.values() for i, x in enumerate(g)}
    assert {(x.part_id, x.retailer_id, x.observed_at): (x.place, x.low, x.high) for x in P.placed(df, keys, ties).collect()} == want
    facts = {x[keys[0]]: x for x in P.summary(df, keys, ties).collect()}
    assert facts.keys() == groups.keys()
    for key, g in groups.items():
        p, x = np.array([y[3] for y in g], float), facts[key]
        drift = np.polyfit(np.arange(len(p)), p, 1)[0] * (len(p) - 1) if len(p) > 1 else 0.0
        trend = "flat" if len(p) < 2 or abs(drift) <= 0.01 * p.mean() else "up" if drift > 0 else "down"
        assert (x.min_cents, x.max_cents, x.last_cents, x.last_at, x.observations, x.trend) == (p.min(), p.max(), g[-1][3], g[-1][2], len(g), trend)
    assert {f.trend for f in facts.values()} >= {"flat", "up"}
    assert P.summary(df.limit(0), keys, ties).collect() == [] == P.placed(df.limit(0), keys, ties).collect()


@pytest.mark.parametrize("whole", (0, 3, 4, 10**6))
def test_places_of_small_and_of_great_groups(spark, whole):
    """Groups up to a size are ordered as a whole, others by ranges, with the same places; a null key is a group too."""
    rows = [*history_rows(), (None, 1, AT(0), 5), (None, 2, AT(0), 9), (6, 1, None, 3), (6, 2, AT(1), 2), (6, None, AT(1), 8), (7, 1, AT(0), None)]
    groups = defaultdict(list)
    for x in sorted(rows, key=lambda x: (x[2] is not None, x[2] or AT(0), x[1] is not None, x[1] or 0)):
        groups[x[0]].append(x)
    ends = {k: [f((y[3] for y in g if y[3] is not None), default=None) for f in (min, max)] for k, g in groups.items()}
    want = [(*x, i, *ends[k]) for k, g in groups.items() for i, x in enumerate(g)]
    got = P.placed(spark.createDataFrame(rows, HISTORY), ["part_id"], ["retailer_id"], whole)
    assert got.columns == ["part_id", "retailer_id", "observed_at", "price_cents", "place", "low", "high"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_places_of_small_groups_need_no_other_shuffle(spark):
    """The memory of a task would follow the table where rows are dealt anew, into partitions that are merged to the number of cores."""
    dealt = spark.createDataFrame(history_rows(), HISTORY).repartition(6, "part_id")
    got = P.placed(dealt, ["part_id"], ["retailer_id"])
    assert got.count() == dealt.count()
    out = got.select("part_id", "place", "low", "high")
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "Join" not in final


def test_anchors_of_each_row_and_carried_points(spark):
    rows = [(1, 1, AT(0), 10), (1, 1, AT(24), 20), (1, 1, AT(72), 20), (1, 2, AT(24), 5), (1, 2, AT(48), 5), (2, 1, AT(100), 9), (3, 1, AT(24), 8), (3, 1, AT(48), 7)]
    df = spark.createDataFrame(rows, HISTORY)
    wanted = [(1, 1, "a", AT(24)), (1, 1, "b", AT(25)), (1, 1, "c", AT(0)), (1, 2, "a", AT(999)), (2, 1, "a", AT(100)), (9, 9, "a", AT(1)), (1, 1, "n", None)]
    got = {(x.part_id, x.retailer_id, x.name): (x.anchor_at, x.anchor_cents) for x in P.anchors_of(spark.createDataFrame(wanted, "part_id long, retailer_id long, name string, start timestamp"), df).collect()}
    assert got == {(1, 1, "a"): (AT(0), 10), (1, 1, "b"): (AT(24), 20), (1, 1, "c"): (None, None), (1, 2, "a"): (AT(48), 5), (2, 1, "a"): (None, None), (9, 9, "a"): (None, None), (1, 1, "n"): (None, None)}
    # the second retailer's first point in the window is the carried one
    points = {(x.part_id, x.retailer_id): (x.observed_at, x.price_cents) for x in P.carried_in(df, F.lit(AT(48))).collect()}
    assert points == {(1, 1): (AT(48), 20), (3, 1): (AT(48), 8)}


def test_scratch_is_dropped(spark, tmp_path):
    df = tables.kept(spark.range(5).toDF("id"))
    path = tables.SCRATCH[spark.sparkContext.applicationId][-1].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    assert tables.drop_scratch(spark) > 0 and not os.path.isdir(path) and tables.drop_scratch(spark) == 0


def test_anchors_of_windows_are_those_of_each_row(spark):
    """One grouping gives what the as-of join gives, nulls included, and deals the history once."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    seen = [(p, r, day(n), n * 7 % 13) for p in range(3) for r in (0, 1, None) for n in range(p, 420, 11 + 29 * (r or 0))] + [(None, 1, day(3), 1), (9, 1, None, 5)]
    history = spark.createDataFrame(seen, "part_id long, retailer_id long, observed_at timestamp, price_cents long")
    ends = history.groupBy("part_id").agg(F.max("observed_at").alias("end"))
    days = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("days")) for n, d in P.DAYS.items() if d])
    wanted = history.select("part_id", "retailer_id").distinct().join(ends, "part_id").select("part_id", "retailer_id", "end", F.inline(days))
    each = P.anchors_of(wanted.select("part_id", "retailer_id", "name", (F.col("end") - F.make_dt_interval(F.col("days"))).alias("start")), history)
    got = P.anchors_of_windows(history)
    key = lambda df: sorted(map(repr, df.select("part_id", "retailer_id", "name", "start", "anchor_at", "anchor_cents").collect()))
    assert key(got) == key(each) and len(key(got)) == 50
