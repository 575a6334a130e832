"""Queries over build lists (orders), their lines and labour."""

from pyspark.sql import functions as F

from stockwright.functions import ordering as O
from stockwright.operators import builds as B
from stockwright.operators import cascades as C
from stockwright.operators import relations as L
from stockwright.plans.registry import Registry
from stockwright.sources.tables import scratch

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
COST = """(SELECT b.*, parts_cents, labour_cents, base_cents + coalesce(parts_cents, 0) + coalesce(labour_cents, 0) AS total_cents FROM builds b
  LEFT JOIN (SELECT build_id, CAST(sum(quantity * coalesce(price_cents, 0)) AS BIGINT) AS parts_cents FROM lines LEFT JOIN parts ON id = part_id GROUP BY build_id) USING (build_id)
  LEFT JOIN (SELECT build_id, CAST(sum(cost_cents) AS BIGINT) AS labour_cents FROM labour GROUP BY build_id) USING (build_id))"""


def _prices(c):
    return c.parts.select(F.col("id").alias("part_id"), "price_cents")


def _costs(c):
    return B.costs(c.builds, c.lines, c.labour, _prices(c))


@R.add("a16_cost_rollup", f"SELECT build_id, base_cents, parts_cents, labour_cents, total_cents FROM {COST}")
def a16(c):
    return _costs(c).select("build_id", "base_cents", "parts_cents", "labour_cents", "total_cents")


@R.add("p08_cost_range", f"SELECT build_id, total_cents FROM {COST} WHERE total_cents BETWEEN 20000000 AND 60000000")
def p08(c):
    return _costs(c).where("total_cents between 20000000 and 60000000").select("build_id", "total_cents")


@R.add("p07_build_filter", "SELECT build_id, user_id, status FROM builds WHERE status = 'F' AND user_id BETWEEN 10 AND 400")
def p07(c):
    return c.builds.where("status = 'F' and user_id between 10 and 400").select("build_id", "user_id", "status")


@R.add("o05_builds_dearest_first", f"SELECT build_id, total_cents FROM {COST} ORDER BY total_cents DESC, build_id DESC LIMIT 50")
def o05(c):
    return _costs(c).select("build_id", "total_cents").orderBy(F.desc("total_cents"), F.desc("build_id")).limit(50)


@R.add("o05_builds_cheapest_first", f"SELECT build_id, total_cents FROM {COST} ORDER BY total_cents, build_id LIMIT 50")
def o05_up(c):
    return _costs(c).select("build_id", "total_cents").orderBy("total_cents", "build_id").limit(50)


@R.add("l03_offset_page", "SELECT build_id, created_at FROM builds ORDER BY created_at DESC, build_id DESC LIMIT 25 OFFSET 50")
def l03(c):
    return O.offset_page(c.builds.select("build_id", "created_at"), [F.desc("created_at"), F.desc("build_id")], 50, 25)


@R.add("w06_page_facts", "SELECT count(*) AS total, CAST(3 AS BIGINT) AS current_page, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages, count(*) > 75 AS has_next, true AS has_previous FROM builds")
def w06(c):
    return O.page_facts(c.builds, 50, 25)


@R.add("s05_count_by_key", "SELECT count(*) AS n FROM builds WHERE user_id = 7")
def s05(c):
    return c.builds.where("user_id = 7").agg(F.count("*").alias("n"))


@R.add("s11_children_of_builds", "SELECT b.build_id, coalesce(array_to_string(list(phase ORDER BY phase), ','), '') AS phases, count(l.build_id) AS n FROM builds b LEFT JOIN lines l USING (build_id) GROUP BY b.build_id")
def s11(c):
    df = L.with_children(c.builds.select("build_id"), c.lines.select("build_id", "phase"), "build_id", F.col("phase"), "children")
    return df.select("build_id", F.array_join("children", ",").alias("phases"), F.size("children").cast("long").alias("n"))


@R.add("s20_builds_of_user", "SELECT build_id, created_at FROM builds WHERE user_id = 7 ORDER BY created_at DESC, build_id")
def s20(c):
    return c.builds.where("user_id = 7").select("build_id", "created_at").orderBy(F.desc("created_at"), "build_id")


@R.add("s21_lines_in_order", "SELECT build_id, part_id, phase, quantity FROM lines")
def s21(c):
    return c.lines.select("build_id", "part_id", "phase", "quantity").orderBy("build_id", "phase", "part_id", "quantity")


@R.add("a17_builds_with_part", "SELECT part_id, count(DISTINCT build_id) AS n_builds FROM lines GROUP BY part_id")
def a17(c):
    return c.lines.groupBy("part_id").agg(F.countDistinct("build_id").alias("n_builds"))


@R.add("a20_next_sort_order", "SELECT CAST(coalesce(max(phase) + 1, 0) AS BIGINT) AS next_sort_order FROM lines WHERE build_id = 1")
def a20(c):
    return B.next_sort_order(c.lines.where("build_id = 1"), "phase")


@R.add("a27_progress", "SELECT build_id, CAST(sum(CASE WHEN purchased THEN quantity * price_cents ELSE 0 END) AS BIGINT) AS purchased_cents, CAST(sum(CASE WHEN purchased THEN 0 ELSE quantity * price_cents END) AS BIGINT) AS remaining_cents, CAST(CASE WHEN sum(quantity * price_cents) = 0 THEN 0 ELSE floor(sum(CASE WHEN purchased THEN quantity * price_cents ELSE 0 END) * 100.0 / sum(quantity * price_cents) + 0.5) END AS BIGINT) AS progress FROM lines JOIN parts ON id = part_id GROUP BY build_id")
def a27(c):
    return B.progress(c.lines, _prices(c))


@R.add("a32_lines_by_phase", "WITH ph AS (SELECT k AS phase, 'phase ' || k AS label FROM range(1, 6) t(k)) SELECT label, CAST(phase AS BIGINT) AS sort_order, coalesce(n, 0) AS n_lines, coalesce(q, 0) AS quantity FROM ph LEFT JOIN (SELECT phase, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS q FROM lines GROUP BY phase) USING (phase) UNION ALL SELECT 'unassigned', 999999, count(*), CAST(sum(quantity) AS BIGINT) FROM lines WHERE phase NOT IN (SELECT phase FROM ph) HAVING count(*) > 0")
def a32(c):
    phases = c.spark.range(1, 6).select(F.col("id").cast("int").alias("phase"), F.concat(F.lit("phase "), F.col("id")).alias("label"), F.col("id").alias("sort_order"))
    return B.by_phase(phases, c.lines)


@R.add("j05_effective_lines", "SELECT build_id, l.part_id, phase, quantity, purchased, coalesce(q.id, p.id) AS effective_part_id, coalesce(q.name, p.name) AS part_name FROM lines l JOIN parts p ON p.id = l.part_id LEFT JOIN parts q ON q.id = p.canonical_part_id")
def j05(c):
    return B.effective_lines(c.lines, c.parts)


@R.add("j06_line_with_phase", "SELECT build_id, part_id, 'phase ' || phase AS phase_name FROM lines WHERE build_id = 1")
def j06(c):
    names = c.spark.range(1, 8).select(F.col("id").cast("int").alias("phase"), F.concat(F.lit("phase "), F.col("id")).alias("phase_name"))
    return c.lines.where("build_id = 1").join(names, "phase", "left").select("build_id", "part_id", "phase_name")


@R.add("j20_builds_without_lines", "SELECT build_id, user_id, md5('log:' || build_id) AS log_id FROM builds WHERE build_id NOT IN (SELECT build_id FROM lines)")
def j20(c):
    missing = c.builds.join(c.lines.select("build_id"), "build_id", "left_anti")
    return missing.select("build_id", "user_id", F.md5(F.concat(F.lit("log:"), F.col("build_id").cast("string"))).alias("log_id"))


@R.add("u07_copied_build", "SELECT CAST(-1 AS BIGINT) AS build_id, part_id, CAST(phase + 100 AS BIGINT) AS phase, quantity, false AS purchased FROM lines WHERE build_id = 3")
def u07(c):
    phases = c.spark.range(1, 8).select(F.col("id").cast("int").alias("phase"), (F.col("id") + 100).alias("new_phase"))
    return B.copied(c.lines, 3, -1, phases)


@R.add("a18_table_counts", "SELECT 'parts' AS name, count(*) AS n FROM part UNION ALL SELECT 'retailers', count(*) FROM supplier UNION ALL SELECT 'builds', count(*) FROM orders UNION ALL SELECT 'users', count(*) FROM customer")
def a18(c):
    from functools import reduce

    names = {"parts": "part", "retailers": "supplier", "builds": "orders", "users": "customer"}
    return reduce(lambda a, b: a.unionByName(b), [c.raw(t).agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in names.items()])


@R.add("m04_build_cascade", "WITH g AS (SELECT build_id FROM builds WHERE user_id % 7 = 0), p AS (SELECT DISTINCT build_id * 10 + phase AS phase_id, build_id FROM lines), l AS (SELECT build_id AS log_id, build_id FROM builds WHERE build_id % 3 = 0), t AS (SELECT event_id AS post_id, event_id % 1000 AS log_id FROM events) SELECT 'builds' AS name, count(*) AS before, count(*) FILTER (build_id NOT IN (FROM g)) AS \"left\", CAST(0 AS BIGINT) AS cleared, CAST(sum(build_id) FILTER (build_id NOT IN (FROM g)) AS BIGINT) AS sum FROM builds UNION ALL SELECT 'lines', count(*), count(*) FILTER (build_id NOT IN (FROM g)), 0, CAST(sum(build_id * 10 + phase) FILTER (build_id NOT IN (FROM g)) AS BIGINT) FROM lines UNION ALL SELECT 'phases', count(*), count(*) FILTER (build_id NOT IN (FROM g)), 0, CAST(sum(phase_id) FILTER (build_id NOT IN (FROM g)) AS BIGINT) FROM p UNION ALL SELECT 'logs', count(*), count(*) FILTER (build_id NOT IN (FROM g)), 0, CAST(sum(log_id) FILTER (build_id NOT IN (FROM g)) AS BIGINT) FROM l UNION ALL SELECT 'posts', count(*), count(*) FILTER (log_id NOT IN (SELECT log_id FROM l WHERE build_id IN (FROM g))), 0, CAST(sum(post_id) FILTER (log_id NOT IN (SELECT log_id FROM l WHERE build_id IN (FROM g))) AS BIGINT) FROM t")
def m04(c):
    """The lists of every seventh user go, with lines and phases, their logs and the posts in these."""
    lines = c.lines.select("build_id", "phase")
    tables = {
        "builds": C.Table(c.builds.select("build_id", "user_id"), ("build_id",)), "lines": C.Table(lines, ("build_id", "phase")),
        "phases": C.Table(lines.distinct().withColumn("phase_id", F.col("build_id") * 10 + F.col("phase")).select("phase_id", "build_id"), ("phase_id",)),
        "logs": C.Table(c.builds.where("build_id % 3 = 0").select(F.col("build_id").alias("log_id"), "build_id"), ("log_id",)), "posts": C.Table(c.raw("events").select(F.col("event_id").alias("post_id"), (F.col("event_id") % 1000).alias("log_id")), ("post_id",)),
    }
    graph = [C.Reference(t, k, p) for t, k, p in (("lines", "build_id", "builds"), ("phases", "build_id", "builds"), ("logs", "build_id", "builds"), ("posts", "log_id", "logs"))]
    cascade = C.Cascade(tables, graph, scratch(c.spark))
    sums = {"builds": "build_id", "lines": "build_id * 10 + phase", "phases": "phase_id", "logs": "log_id", "posts": "post_id"}
    return cascade.report(cascade.run("builds", c.builds.where("user_id % 7 = 0").select("build_id")), {k: F.expr(v) for k, v in sums.items()})


@R.add("m05_phase_set_null", "SELECT build_id, part_id, CASE WHEN phase <> 2 THEN phase END AS phase FROM lines")
def m05(c):
    gone = c.spark.range(2, 3).select(F.col("id").cast("int").alias("phase"))
    return L.set_null(c.lines.select("build_id", "part_id", "phase"), "phase", gone, "phase")


@R.add("j09_builds_with_two_users", "SELECT b.build_id, u.username AS reporter, v.username AS assignee FROM builds b LEFT JOIN users u ON u.user_id = b.user_id LEFT JOIN users v ON v.user_id = b.user_id + 100")
def j09(c):
    names = c.users.select("user_id", "username")
    b = c.builds.select("build_id", "user_id", (F.col("user_id") + 100).alias("other"))
    b = b.join(names.withColumnRenamed("username", "reporter"), "user_id", "left")
    return b.join(names.select(F.col("user_id").alias("other"), F.col("username").alias("assignee")), "other", "left").select("build_id", "reporter", "assignee")


@R.add("j11_users_with_builds", "SELECT u.user_id, coalesce(array_to_string(list(b.build_id ORDER BY b.created_at DESC, b.build_id DESC), ','), '') AS builds FROM users u LEFT JOIN builds b USING (user_id) GROUP BY u.user_id")
def j11(c):
    newest = c.builds.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "build_id")), asc=False).alias("b"))
    return c.users.select("user_id").join(newest, "user_id", "left").select("user_id", F.coalesce(F.array_join(F.col("b.build_id").cast("array<string>"), ","), F.lit("")).alias("builds"))
