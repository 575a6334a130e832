"""Collects queries and their SQL; the views of sources.tables stand before each SQL text as common table expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockwright.sources.tables import Catalogue

#: The instant that counts as now, after the last day of the price history and inside the events.
AS_OF, AS_OF_EVENTS = "2001-11-05 00:00:00", "2024-01-31 00:00:00"
VIEWS = {
    "parts": """SELECT p_partkey AS id, p_name AS name, p_brand AS manufacturer, p_type AS category, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, p_size AS size,
        CASE WHEN min(p_partkey) OVER (PARTITION BY p_brand, p_name) < p_partkey THEN min(p_partkey) OVER (PARTITION BY p_brand, p_name) END AS canonical_part_id FROM part""",
    "retailers": "SELECT s_suppkey AS retailer_id, s_name AS retailer_name, s_nationkey AS model_id FROM supplier",
    "history": """SELECT l_partkey AS part_id, l_suppkey AS retailer_id, l_shipdate AS observed_at, min(CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT)) AS price_cents
        FROM lineitem GROUP BY ALL""",
    "listings": "SELECT part_id, retailer_id, arg_max(price_cents, observed_at) AS price_cents, max(observed_at) AS updated_at FROM history GROUP BY ALL",
    "builds": "SELECT o_orderkey AS build_id, o_custkey AS user_id, CAST(round(o_totalprice * 100) AS BIGINT) AS base_cents, o_orderstatus AS status, o_orderdate AS created_at FROM orders",
    "lines": "SELECT l_orderkey AS build_id, l_partkey AS part_id, l_linenumber AS phase, CAST(l_quantity AS BIGINT) AS quantity, l_linestatus = 'F' AS purchased FROM lineitem",
    "labour": "SELECT l_orderkey AS build_id, CAST(round(l_tax * l_extendedprice * 100) AS BIGINT) AS cost_cents FROM lineitem WHERE l_returnflag = 'R'",
    "users": "SELECT c_custkey AS user_id, c_name AS username, c_nationkey AS model_id, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS balance_cents FROM customer",
    "ballots": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS entity_id, user_id,
        CASE WHEN event_type IN ('purchase', 'click') THEN 'upvote' WHEN event_type = 'error' THEN 'downvote' ELSE 'other' END AS vote_type, ts AS created_at FROM events""",
    "ballots_latest": "SELECT entity_id, user_id, arg_max(vote_type, (created_at, event_id)) AS vote_type, max(created_at) AS created_at FROM ballots GROUP BY ALL",
    "alerts": """SELECT DISTINCT o_custkey AS user_id, l_partkey AS part_id, CAST(round(p_retailprice * 100) AS BIGINT) AS threshold_cents
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
}
ORDER = list(VIEWS)


def with_views(sql: str) -> str:
    """The SQL after the views that it uses, and those that they use."""
    used, text = [], sql
    for name in reversed(ORDER):
        if re.search(rf"\b{name}\b", text):
            used.insert(0, name)
            text += VIEWS[name]
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    if not used:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{views}, {sql[len(start) :]}"
    return f"WITH {views} {sql}"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable[[Catalogue], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
            if sql is not None:
                self.sql[name] = with_views(sql)
            return f

        return keep
