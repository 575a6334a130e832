"""Queries over votes (events) and reports (labels)."""

from pyspark.sql import functions as F

from stockwright.operators import votes as V
from stockwright.plans.registry import AS_OF_EVENTS, Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
FLAGGED = f"""(SELECT * FROM (SELECT entity_id, count(*) AS total, count(*) FILTER (vote_type = 'downvote') AS downvotes,
  count(*) FILTER (vote_type = 'downvote' AND created_at >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY) AS recent_downvotes, count(*) FILTER (vote_type = 'downvote') / count(*) AS down_ratio
  FROM ballots_latest GROUP BY 1) WHERE total >= 5 AND (down_ratio >= 0.3 OR recent_downvotes >= 3))"""


@R.add("a10_tallies", "SELECT entity_id, count(*) FILTER (vote_type = 'upvote') AS upvotes, count(*) FILTER (vote_type = 'downvote') AS downvotes, count(*) FILTER (vote_type = 'upvote') - count(*) FILTER (vote_type = 'downvote') AS net_votes FROM ballots_latest GROUP BY 1")
def a10(c):
    return V.tally(V.latest(c.ballots))


@R.add("a11_net_votes", "SELECT entity_id, CAST(sum(CASE vote_type WHEN 'upvote' THEN 1 WHEN 'downvote' THEN -1 ELSE 0 END) AS BIGINT) AS net_votes FROM ballots GROUP BY 1")
def a11(c):
    return V.tally(c.ballots).select("entity_id", "net_votes")


@R.add("a12_vote_summary", "SELECT t.entity_id, up AS upvotes, down AS downvotes, up - down AS net_votes, up + down AS total_votes, own.vote_type AS own_vote FROM (SELECT entity_id, count(*) FILTER (vote_type = 'upvote') AS up, count(*) FILTER (vote_type = 'downvote') AS down FROM ballots_latest GROUP BY 1) t LEFT JOIN (SELECT * FROM ballots_latest WHERE user_id = 5) own USING (entity_id)")
def a12(c):
    return V.summary_for(V.latest(c.ballots), 5)


@R.add("a13_flagged", f"SELECT entity_id, total, downvotes, recent_downvotes, down_ratio FROM {FLAGGED}")
def a13(c):
    return V.flagged(V.latest(c.ballots), AS_OF_EVENTS)


@R.add("l04_top_flagged", f"SELECT f.*, p.name FROM (SELECT * FROM {FLAGGED} ORDER BY down_ratio DESC, recent_downvotes DESC, entity_id LIMIT 10) f JOIN (SELECT CAST(id AS INTEGER) AS entity_id, name FROM parts WHERE id % 3 <> 0) p USING (entity_id)")
def l04(c):
    parts = c.parts.where("id % 3 <> 0").select(F.col("id").cast("int").alias("entity_id"), "name")
    return V.top_flagged(V.latest(c.ballots), parts, 10, AS_OF_EVENTS)


@R.add("j15_flagged_with_reports", f"SELECT f.entity_id, f.down_ratio, d.doc_id IS NOT NULL AS has_reports FROM {FLAGGED} f JOIN documents x ON x.doc_id = f.entity_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) d ON d.doc_id = f.entity_id")
def j15(c):
    reported = c.raw("labels").where("toxic = 1").select(F.col("doc_id").alias("entity_id"), F.lit(True).alias("r")).distinct()
    known = c.raw("documents").select(F.col("doc_id").alias("entity_id"))
    f = V.flagged(V.latest(c.ballots), AS_OF_EVENTS).join(known, "entity_id")
    return f.join(reported, "entity_id", "left").select(F.col("entity_id").cast("int").alias("entity_id"), "down_ratio", F.coalesce("r", F.lit(False)).alias("has_reports"))


@R.add("a14_count_by_type", "SELECT event_type AS entity_type, count(*) AS n FROM events GROUP BY 1")
def a14(c):
    return c.raw("events").groupBy(F.col("event_type").alias("entity_type")).agg(F.count("*").alias("n"))


@R.add("m09_latest_votes", "SELECT entity_id, user_id, vote_type, created_at FROM ballots_latest")
def m09(c):
    return V.latest(c.ballots)


@R.add("s12_votes_of_entities", "SELECT entity_id, user_id, vote_type FROM ballots_latest WHERE entity_id IN (1, 2, 3)")
def s12(c):
    return V.latest(c.ballots.where(F.col("entity_id").isin(1, 2, 3))).select("entity_id", "user_id", "vote_type")


@R.add("j08_reports_with_documents", "SELECT l.doc_id, quality, coalesce(d.source, '') AS source, coalesce(d.lang, 'Unknown document') AS entity FROM labels l LEFT JOIN documents d USING (doc_id) WHERE toxic = 1")
def j08(c):
    d = c.raw("documents").select("doc_id", "source", "lang")
    return c.raw("labels").where("toxic = 1").join(d, "doc_id", "left").select("doc_id", "quality", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("Unknown document")).alias("entity"))


@R.add("m10_reports_without_pending", "WITH a AS (SELECT event_id AS report_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity_id FROM events WHERE event_type IN ('error', 'click')), h AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity_id FROM events WHERE event_type = 'signup') SELECT report_id, CASE WHEN p.id IS NULL THEN 'not found' WHEN p.size = a.user_id THEN 'own' WHEN h.user_id IS NOT NULL OR report_id <> min(report_id) OVER (PARTITION BY a.user_id, a.entity_id) THEN 'already reported' ELSE 'created' END AS verdict FROM a LEFT JOIN (SELECT * FROM parts WHERE id % 9 <> 0) p ON p.id = a.entity_id LEFT JOIN h ON h.user_id = a.user_id AND h.entity_id = a.entity_id")
def m10(c):
    """Reports on parts: some parts are gone, some are the user's own, some have been reported by the user before."""
    entity = F.get_json_object("props", "$.k").cast("long").alias("entity_id")
    asked = c.raw("events").where("event_type in ('error', 'click')").select(F.col("event_id").alias("report_id"), "user_id", entity)
    pending = c.raw("events").where("event_type = 'signup'").select("user_id", entity)
    return V.report_verdicts(asked, c.parts.where("id % 9 <> 0").select(F.col("id").alias("entity_id"), F.col("size").alias("owner_id")), pending)

