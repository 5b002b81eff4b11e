"""Streaming flows run to completion over the given tables, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.session import scratch_path
from corpusgraph.sources.keyed import KeyedTable
from corpusgraph.streaming import flows
from workload.registry import query, stored_once, table
from workload.text_queries import RUNS_SQL, TRIM, chunk_sql


def stream(spark, sf, name):
    # A table is one file or a folder of part files; only a path with a wildcard may be either.
    return flows.stream_ingest(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


def finish(q):
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def rows_of(spark, stream_df, name):
    path = scratch_path(spark, name)
    finish(flows.to_table(stream_df, path))
    return spark.read.parquet(f"{path}/rows")


@query("stream_ingest", "SELECT doc_id, md5(text) AS content_hash FROM documents")
def stream_ingest(spark, sf):
    return rows_of(spark, stream(spark, sf, "documents").select("doc_id", F.md5("text").alias("content_hash")), "ingest")


@query("stream_dedup", "SELECT DISTINCT md5(text) AS content_hash FROM documents")
def stream_dedup(spark, sf):
    hashed = stream(spark, sf, "documents").select(F.md5("text").alias("content_hash"), F.expr("timestamp '2024-01-01 00:00:00' + doc_id * interval '1' second").alias("ts"))
    return rows_of(spark, flows.stream_dedup(hashed, "content_hash", "ts", "3650 days"), "dedup").select("content_hash")


@query("stream_dedup_permanent", "SELECT md5(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def stream_dedup_permanent(spark, sf):
    path = scratch_path(spark, "dedup")
    hashed = stream(spark, sf, "documents").select(F.md5("text").alias("content_hash"), "doc_id")
    finish(flows.each_batch(hashed, path, flows.dedup_batch(path, "content_hash", "doc_id")))
    return spark.read.parquet(f"{path}/rows").select("content_hash", "doc_id")


@query("dead_letter", "SELECT event_id, user_id % 6 AS attempts, CASE WHEN user_id % 6 > 3 THEN 'dead' ELSE 'live' END AS sink FROM events")
def dead_letter(spark, sf):
    path = scratch_path(spark, "letters")
    rows = stream(spark, sf, "events").select("event_id", (F.col("user_id") % 6).alias("attempts"))
    finish(flows.each_batch(rows, path, flows.split_dead_letters(path)))
    parts = [spark.read.parquet(f"{path}/{s}").select("event_id", "attempts", F.lit(s).alias("sink")) for s in ("live", "dead")]
    return parts[0].unionByName(parts[1])


def closed_windows(spark, sf, name, length, slide=None):
    """Windows the final watermark has closed; append mode emits no others."""
    ev = stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows_of(spark, flows.stream_throughput(ev, "ts", length, slide), name)


@query(
    "stream_throughput",
    """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + interval '1' hour AS "end", count(*) AS docs FROM events
 GROUP BY 1, 2 HAVING date_trunc('hour', ts) + interval '1' hour <= (SELECT max(ts) - interval '10' minute FROM events)""",
)
def stream_throughput(spark, sf):
    return closed_windows(spark, sf, "throughput", "1 hour")


@query(
    "stream_throughput_sliding",
    """SELECT s AS start, s + interval '1' hour AS "end", count(*) AS docs FROM (
 SELECT time_bucket(interval '5' minute, ts) - k * interval '5' minute AS s FROM events, range(12) r(k)) q
 GROUP BY 1 HAVING s + interval '1' hour <= (SELECT max(ts) - interval '10' minute FROM events)""",
)
def stream_throughput_sliding(spark, sf):
    return closed_windows(spark, sf, "sliding", "1 hour", "5 minutes")


@query(
    "rate_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < interval '2' hour THEN 0 ELSE 1 END AS opens FROM events),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT user_id AS "user", min(ts) AS start, max(ts) + interval '2' hour AS "end", count(*) AS hits FROM s GROUP BY user_id, n
 HAVING max(ts) + interval '2' hour <= (SELECT max(ts) - interval '10' minute FROM events)""",
)
def rate_sessions(spark, sf):
    ev = stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows_of(spark, flows.session_hits(ev, "user_id", "ts", "2 hours", "10 minutes"), "sessions")


@query(
    "rate_limit_exact",
    """WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 r AS (SELECT user_id, event_id, ts, i, true AS accepted, 1 AS n, ts AS last FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.ts, o.i, o.ts - r.last >= interval '7200' second OR r.n < 2,
   CASE WHEN o.ts - r.last >= interval '7200' second THEN 1 WHEN r.n < 2 THEN r.n + 1 ELSE r.n END,
   CASE WHEN o.ts - r.last >= interval '7200' second OR r.n < 2 THEN o.ts ELSE r.last END
  FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
 SELECT user_id AS "user", event_id AS event, ts, accepted FROM r""",
)
def rate_limit_exact(spark, sf):
    limited = flows.rate_limit_exact(stream(spark, sf, "events"), "user_id", "ts", "event_id", limit=2, ttl_seconds=7200.0)
    return rows_of(spark, limited, "limit")


@query(
    "stall_alerts",
    """WITH RECURSIVE o AS MATERIALIZED (SELECT user_id AS doc, ts, event_type = 'click' AS starts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'click') AS i FROM events WHERE event_type IN ('click', 'purchase')),
 r AS (SELECT doc, i, CASE WHEN starts THEN ts END AS claimed, CAST(NULL AS TIMESTAMP) AS alert FROM o WHERE i = 1
  UNION ALL SELECT o.doc, o.i, CASE WHEN o.starts THEN CASE WHEN r.claimed IS NULL OR o.ts >= r.claimed + interval '30' minute THEN o.ts ELSE r.claimed END END,
   CASE WHEN o.ts >= r.claimed + interval '30' minute THEN r.claimed END FROM r JOIN o ON o.doc = r.doc AND o.i = r.i + 1)
 SELECT doc, alert AS claimed_at FROM r WHERE alert IS NOT NULL
 UNION ALL SELECT doc, claimed FROM r JOIN (SELECT doc, max(i) AS i FROM o GROUP BY 1) q USING (doc, i)
  WHERE claimed + interval '30' minute < (SELECT max(ts) - interval '10' minute FROM o)""",
)
def stall_alerts(spark, sf):
    ev = stream(spark, sf, "events").where("event_type IN ('click', 'purchase')")
    kind = F.when(F.col("event_type") == "click", "processing").otherwise("completed")
    return rows_of(spark, flows.stall_alerts(ev.withColumn("kind", kind), "user_id", "ts", "kind", 30), "stalls")


@query(
    "latest_status",
    "SELECT user_id AS doc, arg_max(event_type, (ts, event_type)) AS status, max(ts) AS since, count(*) AS changes FROM events GROUP BY 1",
)
def latest_status(spark, sf):
    path = scratch_path(spark, "status")
    latest = flows.latest_status(stream(spark, sf, "events"), "user_id", "ts", "event_type")
    finish(flows.each_batch(latest, path, flows.upsert_latest(path, "doc"), mode="update"))
    return flows.read_latest(spark, path)


def _piped(spark, sf):
    def write(path):
        finish(flows.each_batch(stream(spark, sf, "documents"), path, flows.pipeline_batch(path)))

    return stored_once(spark, sf, "flow", write)


@query(
    "stream_routes",
    f"SELECT doc_id, CASE WHEN length({TRIM.format('text')}) < 50 THEN 'needs_ocr' ELSE 'completed' END AS route FROM documents",
)
def stream_routes(spark, sf):
    return spark.read.parquet(f"{_piped(spark, sf)}/routes").select("doc_id", "route")


@query(
    "stream_chunks",
    f"""SELECT doc_id, chunk_index, start_char, end_char FROM ({chunk_sql(6000, 500)}) c WHERE doc_id IN (SELECT doc_id FROM documents WHERE length({TRIM.format('text')}) >= 50)""",
)
def stream_chunks(spark, sf):
    return spark.read.parquet(f"{_piped(spark, sf)}/chunks").select("doc_id", "chunk_index", "start_char", "end_char")


COMPLETED = f"SELECT doc_id FROM documents WHERE length({TRIM.format('text')}) >= 50"
_ID = "CAST(('0x' || substr(md5({} || '|' || {}), 1, 15)) AS BIGINT)"


@query("stream_mentions", f"WITH {RUNS_SQL} SELECT doc_id, name, mention_count FROM runs WHERE doc_id IN ({COMPLETED})")
def stream_mentions(spark, sf):
    return spark.read.parquet(f"{_piped(spark, sf)}/mentions").select("doc_id", "name", "mention_count")


@query(
    "stream_graph",
    f"""WITH {RUNS_SQL}, kept AS (SELECT * FROM runs WHERE doc_id IN ({COMPLETED})), e AS (SELECT {_ID.format("'Person'", 'name')} AS src, {_ID.format("'Document'", 'doc_id')} AS dst, name, doc_id, mention_count FROM kept)
 SELECT src AS id, 'Person' AS label, name, count(*) AS degree, CAST(sum(mention_count) AS BIGINT) AS mentions FROM e GROUP BY 1, 3
 UNION ALL SELECT dst, 'Document', CAST(doc_id AS VARCHAR), count(*), CAST(sum(mention_count) AS BIGINT) FROM e GROUP BY 1, 3""",
)
def stream_graph(spark, sf):
    """The nodes that the stream stored, with what its edges say of each."""
    path = _piped(spark, sf)
    found = spark.read.parquet(f"{path}/edges")
    ends = found.select(F.explode(F.array("src", "dst")).alias("id"), "count")
    told = ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("count").alias("mentions"))
    return KeyedTable(spark, f"{path}/nodes").read().join(told, "id")
