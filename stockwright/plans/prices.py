"""Queries over the price history and the current listings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockwright.operators import prices as P
from stockwright.plans.registry import AS_OF, Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
T90 = f"TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY"
T1Y = f"TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY"
TREND = """CASE WHEN count(*) < 2 OR avg(price_cents) = 0 THEN 'flat' WHEN regr_slope(price_cents, n) * (count(*) - 1) > 0.01 * abs(avg(price_cents)) THEN 'up'
    WHEN regr_slope(price_cents, n) * (count(*) - 1) < -0.01 * abs(avg(price_cents)) THEN 'down' ELSE 'flat' END"""


@R.add(
    "price_history_batch_summary",
    f"""SELECT q.part_id, min_cents, max_cents, last_cents, last_at, coalesce(observations, 0) AS observations, coalesce(trend, 'flat') AS trend
    FROM (SELECT id AS part_id, coalesce(canonical_part_id, id) AS g FROM parts) q LEFT JOIN (
      SELECT g, min(price_cents) AS min_cents, max(price_cents) AS max_cents, arg_max(price_cents, n) AS last_cents, max(observed_at) AS last_at, count(*) AS observations, {TREND} AS trend
      FROM (SELECT coalesce(p.canonical_part_id, p.id) AS g, h.*, row_number() OVER (PARTITION BY coalesce(p.canonical_part_id, p.id) ORDER BY observed_at, part_id, retailer_id) AS n
            FROM history h JOIN parts p ON p.id = h.part_id WHERE observed_at >= {T1Y}) GROUP BY g) s USING (g)""",
)
def a04(c):
    requested = c.parts.select(F.col("id").alias("part_id"))
    return P.batch_summary(requested, c.parts, P.within(c.history, "1y", AS_OF))


@R.add(
    "a01_single_part_summary",
    f"""SELECT part_id, min(price_cents) AS min_cents, max(price_cents) AS max_cents, arg_max(price_cents, n) AS last_cents, max(observed_at) AS last_at, count(*) AS observations, {TREND} AS trend
    FROM (SELECT h.*, row_number() OVER (PARTITION BY part_id ORDER BY observed_at, retailer_id) AS n FROM history h JOIN retailers USING (retailer_id)) GROUP BY part_id""",
)
def a01(c):
    return P.summary(c.history.join(c.retailers.select("retailer_id"), "retailer_id", "left_semi"), ["part_id"])


@R.add(
    "a02_retailer_breakdown",
    f"""SELECT part_id, retailer_id, retailer_name, min(price_cents) AS min_cents, max(price_cents) AS max_cents, arg_max(price_cents, observed_at) AS last_cents, max(observed_at) AS last_at, count(*) AS observations
    FROM history JOIN retailers USING (retailer_id) WHERE observed_at >= {T1Y} GROUP BY ALL""",
)
def a02(c):
    return P.summary(P.within(c.history, "1y", AS_OF).join(c.retailers.drop("model_id"), "retailer_id"), ["part_id", "retailer_id", "retailer_name"], with_trend=False)


@R.add("a03_retailer_slice", f"SELECT part_id, min(price_cents) AS min_cents, max(price_cents) AS max_cents, arg_max(price_cents, n) AS last_cents, max(observed_at) AS last_at, count(*) AS observations, {TREND} AS trend FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY observed_at, retailer_id) AS n FROM history WHERE retailer_id = 3) GROUP BY part_id")
def a03(c):
    return P.summary(c.history.where("retailer_id = 3"), ["part_id"])


@R.add("a06_best_price_of_group", "SELECT p.id, b.best_cents FROM parts p LEFT JOIN (SELECT coalesce(canonical_part_id, id) AS g, min(CASE WHEN l.price_cents >= 0 THEN l.price_cents END) AS best_cents FROM listings l JOIN parts ON id = part_id GROUP BY 1) b ON b.g = coalesce(p.canonical_part_id, p.id)")
def a06(c):
    return P.best_price(c.listings, c.parts)


@R.add("a07_best_listing", "SELECT part_id, arg_min(retailer_id, (price_cents, retailer_id)) AS retailer_id, min(price_cents) AS price_cents FROM listings GROUP BY part_id")
def a07(c):
    return P.best_listing(c.listings)


@R.add("a08_daily_observation", "SELECT user_id, date_trunc('day', ts) AS day, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS price_cents, arg_max(ts, event_id) AS observed_at FROM events GROUP BY ALL")
def a08(c):
    seen = c.raw("events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("price_cents"), F.col("ts").alias("observed_at"), "event_id")
    return P.daily(seen, ["user_id"], "event_id")


@R.add("a09_best_price_drift", "SELECT p.id, p.price_cents, b.best_cents FROM parts p JOIN (SELECT coalesce(canonical_part_id, id) AS g, min(l.price_cents) AS best_cents FROM listings l JOIN parts ON id = part_id GROUP BY 1) b ON b.g = coalesce(p.canonical_part_id, p.id) WHERE b.best_cents <> p.price_cents")
def a09(c):
    return c.parts.select("id", "price_cents").join(P.best_price(c.listings, c.parts), "id").where("best_cents <> price_cents")


@R.add("a21_batch_meta", f"SELECT count(*) FILTER (n > 0) AS found_count, CAST(sum(n) AS BIGINT) AS rows_scanned FROM (SELECT p.id, count(h.part_id) AS n FROM parts p LEFT JOIN (SELECT * FROM history WHERE observed_at >= {T90}) h ON h.part_id = p.id GROUP BY p.id)")
def a21(c):
    n = P.within(c.history, "90d", AS_OF).groupBy("part_id").count()
    return c.parts.join(n, F.col("id") == F.col("part_id"), "left").agg(F.count_if(F.col("count") > 0).alias("found_count"), F.sum(F.coalesce("count", F.lit(0))).alias("rows_scanned"))


@R.add("a28_chart_points", "SELECT part_id, retailer_id, date_trunc('day', observed_at) AS day, arg_max(price_cents, observed_at) AS price_cents FROM history GROUP BY ALL")
def a28(c):
    last = F.max_by("price_cents", "observed_at").alias("price_cents")
    return c.history.groupBy("part_id", "retailer_id", F.date_trunc("day", "observed_at").alias("day")).agg(last)


@R.add("a29_axis_bounds", "WITH e AS (SELECT min(price_cents) AS low, max(price_cents) AS high FROM history), a AS (SELECT greatest(low - greatest(CAST(floor((high - low) * 0.1) AS BIGINT), 100), 0) AS axis_min, high + greatest(CAST(floor((high - low) * 0.1) AS BIGINT), 100) AS axis_max FROM e) SELECT axis_min, axis_max, (SELECT min(1000 * CAST(pow(2, k) AS BIGINT)) FROM range(51) t(k) WHERE (axis_max - axis_min) / (1000 * CAST(pow(2, k) AS BIGINT)) <= 12) AS step FROM a")
def a29(c):
    return P.axis(c.history)


@R.add("j03_history_with_retailer", f"SELECT part_id, retailer_id, retailer_name, observed_at, price_cents FROM history JOIN listings l USING (part_id, retailer_id, price_cents) JOIN retailers USING (retailer_id) WHERE observed_at >= {T90} AND l.updated_at = observed_at")
def j03(c):
    at = c.listings.select("part_id", "retailer_id", "price_cents", F.col("updated_at").alias("observed_at"))
    return P.within(c.history, "90d", AS_OF).join(at, ["part_id", "retailer_id", "price_cents", "observed_at"], "left_semi").join(c.retailers.drop("model_id"), "retailer_id").select("part_id", "retailer_id", "retailer_name", "observed_at", "price_cents")


@R.add("j04_listings_with_retailer", "SELECT part_id, retailer_id, retailer_name, price_cents, updated_at FROM listings JOIN retailers USING (retailer_id)")
def j04(c):
    return c.listings.join(c.retailers.drop("model_id"), "retailer_id")


@R.add("j07_parts_of_retailer", "SELECT id, name FROM parts WHERE id IN (SELECT part_id FROM listings WHERE retailer_id = 5)")
def j07(c):
    return c.parts.select("id", "name").join(c.listings.where("retailer_id = 5").select(F.col("part_id").alias("id")), "id", "left_semi")


@R.add("j14_alerts_met", f"SELECT DISTINCT user_id, part_id, retailer_id, threshold_cents, l.price_cents FROM alerts JOIN listings l USING (part_id) JOIN retailers USING (retailer_id) JOIN users USING (user_id) WHERE threshold_cents >= l.price_cents AND updated_at >= {T90}")
def j14(c):
    fresh = c.listings.where(F.col("updated_at") >= P.window_start("90d", AS_OF)).join(c.retailers.select("retailer_id"), "retailer_id", "left_semi")
    met = c.alerts_for(fresh).join(fresh, "part_id").where("threshold_cents >= price_cents")
    return met.join(c.users.select("user_id"), "user_id", "left_semi").select("user_id", "part_id", "retailer_id", "threshold_cents", "price_cents")


@R.add("j21_history_and_listing_rows", f"SELECT part_id, retailer_id, coalesce(h.last_cents, l.price_cents, 0) AS shown_cents, h.part_id IS NOT NULL AS has_history FROM (SELECT part_id, retailer_id, arg_max(price_cents, observed_at) AS last_cents FROM history WHERE observed_at >= {T90} GROUP BY ALL) h FULL JOIN listings l USING (part_id, retailer_id)")
def j21(c):
    h = P.within(c.history, "90d", AS_OF).groupBy("part_id", "retailer_id").agg(F.max_by("price_cents", "observed_at").alias("last_cents")).withColumn("seen", F.lit(True))
    both = h.join(c.listings, ["part_id", "retailer_id"], "full_outer")
    return both.select("part_id", "retailer_id", F.coalesce("last_cents", "price_cents", F.lit(0)).alias("shown_cents"), F.coalesce("seen", F.lit(False)).alias("has_history"))


@R.add("j22_anchor_before_window", f"SELECT part_id, retailer_id, max(observed_at) AS anchor_at, arg_max(price_cents, observed_at) AS anchor_cents FROM history WHERE observed_at < {T90} GROUP BY ALL")
def j22(c):
    return P.anchors(c.history, P.window_start("90d", AS_OF))


@R.add("j22_anchor_of_each_window", "WITH w AS (SELECT part_id, w AS name, e - to_days(CAST(d AS INTEGER)) AS start FROM (SELECT part_id, max(observed_at) AS e FROM history GROUP BY 1), (VALUES ('7d', 7), ('30d', 30), ('90d', 90), ('180d', 180), ('1y', 365)) v(w, d)) SELECT l.part_id, l.retailer_id, name, start, anchor_at, anchor_cents FROM (SELECT part_id, retailer_id, name, start FROM w JOIN listings USING (part_id)) l ASOF LEFT JOIN (SELECT part_id, retailer_id, observed_at AS anchor_at, price_cents AS anchor_cents FROM history) h ON l.part_id = h.part_id AND l.retailer_id = h.retailer_id AND l.start > h.anchor_at")
def j22_each(c):
    """For each listing and named window its anchor; a part's windows end with the last observation of the part."""
    return P.anchors_of_windows(c.history)


@R.add("s17_history_since", f"SELECT part_id, retailer_id, observed_at, price_cents FROM history WHERE observed_at >= {T90}")
def s17(c):
    return P.within(c.history, "90d", AS_OF).select("part_id", "retailer_id", "observed_at", "price_cents")


@R.add("s18_latest_before", "SELECT part_id, retailer_id, max(observed_at) AS anchor_at, arg_max(price_cents, observed_at) AS anchor_cents FROM history WHERE observed_at < TIMESTAMP '1997-01-01' GROUP BY ALL")
def s18(c):
    return P.anchors(c.history, F.lit("1997-01-01").cast("timestamp"))


@R.add("s19_first_between", "SELECT part_id, retailer_id, min(observed_at) AS observed_at, arg_min(price_cents, observed_at) AS price_cents FROM history WHERE observed_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' GROUP BY ALL")
def s19(c):
    some = c.history.where("observed_at between timestamp '1997-01-01' and timestamp '1997-12-31'")
    return some.groupBy("part_id", "retailer_id").agg(F.min("observed_at").alias("observed_at"), F.min_by("price_cents", "observed_at").alias("price_cents"))


@R.add("w01_chronological_place", "SELECT part_id, retailer_id, observed_at, row_number() OVER (PARTITION BY part_id ORDER BY observed_at, retailer_id) - 1 AS place FROM history")
def w01(c):
    return P.placed(c.history, ["part_id"], ["retailer_id"]).select("part_id", "retailer_id", "observed_at", "place")


@R.add("w02_newest_per_retailer", "SELECT retailer_id, part_id, observed_at, price_cents FROM history QUALIFY row_number() OVER (PARTITION BY retailer_id ORDER BY observed_at DESC, part_id DESC) = 1")
def w02(c):
    x = F.max(F.struct("observed_at", "part_id", "price_cents")).alias("x")  # the first in descending order is a greatest row: no sort
    return c.history.groupBy("retailer_id").agg(x).select("retailer_id", "x.part_id", "x.observed_at", "x.price_cents")


@R.add("w03_carried_anchor", f"SELECT part_id, retailer_id, greatest({T90}, date_trunc('day', b.seen_at)) AS observed_at, b.price_cents, seen_at FROM (SELECT part_id, retailer_id, arg_max(price_cents, observed_at) AS price_cents, max(observed_at) AS seen_at FROM history WHERE observed_at < {T90} GROUP BY ALL) b LEFT JOIN (SELECT part_id, retailer_id, min((date_trunc('day', observed_at), price_cents)) AS f FROM history WHERE observed_at >= {T90} GROUP BY ALL) i USING (part_id, retailer_id) WHERE f IS NULL OR f <> (greatest({T90}, date_trunc('day', b.seen_at)), b.price_cents)")
def w03(c):
    return P.carried_in(c.history, P.window_start("90d", AS_OF))


@R.add("w04_price_drops", "SELECT part_id, retailer_id, observed_at, price_cents, before_cents FROM (SELECT *, lag(price_cents) OVER (PARTITION BY part_id, retailer_id ORDER BY observed_at) AS before_cents FROM history) WHERE price_cents >= 0 AND (before_cents IS NULL OR price_cents < before_cents)")
def w04(c):
    return P.drops(c.history)


@R.add("w07_sparkline", "SELECT part_id, retailer_id, observed_at, price_cents, row_number() OVER (w ORDER BY observed_at, retailer_id) - 1 AS x, CASE WHEN max(price_cents) OVER w = min(price_cents) OVER w THEN 0.5 ELSE CAST(price_cents - min(price_cents) OVER w AS DOUBLE) / (max(price_cents) OVER w - min(price_cents) OVER w) END AS y FROM history WINDOW w AS (PARTITION BY part_id)")
def w07(c):
    return P.sparkline(c.history, ["part_id"], ["retailer_id"]).select("part_id", "retailer_id", "observed_at", "price_cents", "x", "y")


@R.add("l06_most_observed_parts", "SELECT part_id, count(*) AS n FROM history GROUP BY part_id ORDER BY n DESC, part_id LIMIT 500")
def l06(c):
    return c.history.groupBy("part_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part_id").limit(500)


@R.add("f24_calendar_windows", "SELECT part_id, min(date_trunc('year', observed_at)) AS first_year, max(date_trunc('month', observed_at)) AS last_month, max(CAST(observed_at AS DATE) - CAST(dayofweek(observed_at) AS INTEGER)) AS last_week FROM history GROUP BY part_id")
def f24(c):
    week = F.date_sub(F.to_date("observed_at"), F.dayofweek("observed_at") - 1)
    return c.history.groupBy("part_id").agg(F.min(F.date_trunc("year", "observed_at")).alias("first_year"), F.max(F.date_trunc("month", "observed_at")).alias("last_month"), F.max(week).alias("last_week"))


@R.add("a05_trend", f"SELECT retailer_id, {TREND} AS trend FROM (SELECT *, row_number() OVER (PARTITION BY retailer_id ORDER BY observed_at, part_id) AS n FROM history WHERE observed_at >= {T1Y}) GROUP BY retailer_id")
def a05(c):
    return P.summary(P.within(c.history, "1y", AS_OF), ["retailer_id"], ["part_id"]).select("retailer_id", "trend")


@R.add("f23_window_starts", f"SELECT w AS name, count(*) AS n FROM history, (VALUES ('7d', 7), ('30d', 30), ('90d', 90), ('180d', 180), ('1y', 365), ('all', 36500)) v(w, d) WHERE observed_at >= TIMESTAMP '{AS_OF}' - to_days(d) GROUP BY w")
def f23(c):
    """How many observations each named window holds, in one pass."""
    starts = F.array(*[F.struct(F.lit(n).alias("name"), (P.window_start(n, AS_OF) if d else F.lit(None).cast("timestamp")).alias("start")) for n, d in P.DAYS.items()])
    inside = c.history.select(F.inline(F.filter(starts, lambda w: w["start"].isNull() | (F.col("observed_at") >= w["start"]))))
    return inside.groupBy("name").agg(F.count("*").alias("n"))


@R.add(
    "f33_chart_groups",
    """WITH RECURSIVE b AS (SELECT part_id, retailer_id, observed_at, epoch_us(observed_at) AS d, price_cents AS c, min(epoch_us(observed_at)) OVER w AS d0, max(epoch_us(observed_at)) OVER w AS d1, min(price_cents) OVER w AS c0, max(price_cents) OVER w AS c1 FROM history WINDOW w AS (PARTITION BY part_id)),
    p AS (SELECT part_id AS chart, CAST(CASE WHEN d1 = d0 THEN 0 ELSE round((d - d0) / (d1 - d0) * 600) END AS BIGINT) AS x, CAST(CASE WHEN c1 = c0 THEN 100 ELSE round((c1 - c) / (c1 - c0) * 200) END AS BIGINT) AS y, (retailer_id, observed_at) AS place FROM b),
    q AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY place) AS n FROM (SELECT chart, x, y, min(place) AS place FROM p GROUP BY ALL)),
    g AS (SELECT chart, n, x, y, [{'x': x, 'y': y}] AS heads, 1 AS head FROM q WHERE n = 1
      UNION ALL SELECT q.chart, q.n, q.x, q.y, CASE WHEN f IS NULL THEN list_append(heads, {'x': q.x, 'y': q.y}) ELSE heads END, coalesce(f, len(heads) + 1)
      FROM (SELECT g.chart, g.n, g.heads, list_position(list_transform(g.heads, lambda h: (h.x - q.x) * (h.x - q.x) + (h.y - q.y) * (h.y - q.y) <= 256), true) AS f FROM g JOIN q ON q.chart = g.chart AND q.n = g.n + 1) s JOIN q ON q.chart = s.chart AND q.n = s.n + 1)
    SELECT chart, x, y, heads[head].x AS head_x, heads[head].y AS head_y FROM g""",
)
def f33(c):
    """Each part's chart, 600 pixels by 200."""
    w = Window.partitionBy("part_id")
    low, high = F.min("price_cents").over(w), F.max("price_cents").over(w)
    day = F.unix_micros(F.col("observed_at").cast("timestamp"))
    first, last = F.min(day).over(w), F.max(day).over(w)
    x = F.when(last == first, 0).otherwise(F.round((day - first) / (last - first) * 600))
    y = F.when(high == low, 100).otherwise(F.round((high - F.col("price_cents")) / (high - low) * 200))
    return P.chart_groups(c.history.select(F.col("part_id").alias("chart"), x.alias("x"), y.alias("y"), F.struct("retailer_id", "observed_at").alias("place")))


@R.add("m14_ingested_observations", "WITH l AS (SELECT part_id, retailer_id, arg_max(CASE WHEN observed_at < TIMESTAMP '2000-01-01' OR part_id % 10 <> 0 THEN price_cents END, observed_at) AS price_cents, max(CASE WHEN observed_at < TIMESTAMP '2000-01-01' OR part_id % 10 <> 0 THEN observed_at END) AS updated_at FROM history GROUP BY ALL), b AS (SELECT coalesce(canonical_part_id, id) AS g, min(CASE WHEN l.price_cents >= 0 THEN l.price_cents END) AS best FROM l JOIN parts ON id = part_id GROUP BY 1) SELECT part_id, retailer_id, l.price_cents, updated_at, best AS best_cents, (SELECT count(*) FROM history WHERE observed_at < TIMESTAMP '2000-01-01' OR part_id % 10 <> 0) AS n_history FROM l LEFT JOIN parts ON id = part_id LEFT JOIN b ON g = coalesce(canonical_part_id, id)")
def m14(c):
    """The history of before 2000 is stored; what came later arrives as one batch, without a price for every tenth part."""
    cut = F.lit("2000-01-01").cast("timestamp")
    stored, later = c.history.where(F.col("observed_at") < cut), c.history.where(F.col("observed_at") >= cut)
    x = F.max(F.struct("observed_at", "price_cents")).alias("x")
    listings = stored.groupBy("part_id", "retailer_id").agg(x).select("part_id", "retailer_id", "x.price_cents", F.col("x.observed_at").alias("updated_at"))
    new, history = P.ingested(listings, stored, later.withColumn("price_cents", F.when(F.col("part_id") % 10 != 0, F.col("price_cents"))))
    new = c.dealt(new, "lineitem", "part_id")  # a full join leaves them dealt by nothing
    best = P.best_price(new, c.parts).withColumnRenamed("id", "part_id")
    return new.join(best, "part_id", "left").join(F.broadcast(history.agg(F.count("*").alias("n_history"))))
