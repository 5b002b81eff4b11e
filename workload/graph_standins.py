"""The mention graph inside the order tables.

Document = order, Person = supplier, Organization = part, Location = nation of
the order's customer.  A line item mentions its supplier and part in its order
and makes the supplier a member of the part's organization.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusgraph.session import bounded_tasks
from workload.registry import table

NODES_SQL = """SELECT o_orderkey * 4 AS id, 'Document' AS label, concat('order_', o_orderkey) AS name FROM orders
 UNION ALL SELECT s_suppkey * 4 + 1 AS id, 'Person' AS label, s_name AS name FROM supplier
 UNION ALL SELECT p_partkey * 4 + 2 AS id, 'Organization' AS label, concat(p_name, ' ', p_partkey) AS name FROM part
 UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 3 AS id, 'Location' AS label, n_name AS name FROM nation"""

MENTIONS_SQL = """SELECT l_suppkey * 4 + 1 AS src, l_orderkey * 4 AS dst, 'MENTIONED_IN' AS type, count(*) AS count FROM lineitem GROUP BY l_suppkey, l_orderkey
 UNION ALL SELECT l_partkey * 4 + 2 AS src, l_orderkey * 4 AS dst, 'MENTIONED_IN' AS type, count(*) AS count FROM lineitem GROUP BY l_partkey, l_orderkey
 UNION ALL SELECT CAST(c_nationkey AS BIGINT) * 4 + 3 AS src, o_orderkey * 4 AS dst, 'MENTIONED_IN' AS type, CAST(1 AS BIGINT) AS count
  FROM orders JOIN customer ON o_custkey = c_custkey"""

MEMBERS_SQL = """SELECT l_suppkey * 4 + 1 AS src, l_partkey * 4 + 2 AS dst, 'MEMBER_OF' AS type, count(*) AS count FROM lineitem GROUP BY l_suppkey, l_partkey"""

GRAPH = f"nodes AS ({NODES_SQL}), edges AS ({MENTIONS_SQL} UNION ALL {MEMBERS_SQL})"
CO_MENTIONED = """co AS (SELECT a.src AS src, b.src AS dst, 'CO_MENTIONED' AS type, count(*) AS count
 FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src AND a.type = 'MENTIONED_IN' AND b.type = 'MENTIONED_IN' AND a.src % 4 = 1 AND b.src % 4 = 1 GROUP BY 1, 2)"""
WAYS = """ways AS (SELECT src AS node, dst AS other, type, count, true AS outgoing FROM edges
 UNION ALL SELECT dst, src, type, count, false FROM edges WHERE src <> dst)"""


def _run(spark, sf, sql: str) -> DataFrame:
    bounded_tasks(spark)
    tables = {t: table(spark, sf, t) for t in ("orders", "supplier", "part", "nation", "lineitem", "customer")}
    for name in tables:
        sql = _named(sql, name)
    return spark.sql(sql, **tables)


def _named(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)


def nodes(spark, sf) -> DataFrame:
    return _run(spark, sf, NODES_SQL)


def mentions(spark, sf) -> DataFrame:
    return _run(spark, sf, MENTIONS_SQL)


def members(spark, sf) -> DataFrame:
    return _run(spark, sf, MEMBERS_SQL)


def edges(spark, sf) -> DataFrame:
    return mentions(spark, sf).unionByName(members(spark, sf))


# Timeline: users take part in events; the event type names the link.
LINKS_SQL = """SELECT user_id AS src, event_id AS dst, CASE event_type WHEN 'click' THEN 'PARTICIPATED_IN' WHEN 'view' THEN 'OCCURRED_AT'
 WHEN 'purchase' THEN 'RELATED_TO' ELSE 'OTHER' END AS type FROM events"""
EVENTS_SQL = "SELECT event_id AS id, substr(CAST(ts AS VARCHAR(30)), 1, 10) AS date, props AS description, event_type AS type FROM events"


def links(spark, sf) -> DataFrame:
    return spark.sql(_named(LINKS_SQL, "events"), events=table(spark, sf, "events"))


def timeline_events(spark, sf) -> DataFrame:
    return spark.sql(_named(EVENTS_SQL, "events"), events=table(spark, sf, "events"))
