"""Structured Streaming versions of ingest, dedup, throughput and monitoring.

Sinks are tables in the folder the caller names; checkpoints sit next to them,
so a restarted query continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from corpusgraph.sources.keyed import KeyedTable, replace


def stream_ingest(spark: SparkSession, path: str, schema: StructType, glob: str = "*", files_per_batch: int = 10) -> DataFrame:
    """A stream over the Parquet files of a folder, a bounded number per batch.

    ``path`` may hold wildcards, which match files and folders of part files alike; ``glob`` chooses among file names.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob)
    return reader.parquet(path)


def to_table(stream: DataFrame, path: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Write a stream to a Parquet table, once through the available data or on a schedule."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.format("parquet").start(f"{path}/rows")


def each_batch(stream: DataFrame, path: str, body: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Run ``body`` for every micro-batch; replayed batches carry the same number."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(body).start()


def stream_dedup(stream: DataFrame, key: str, ts: str, within: str = "1 day") -> DataFrame:
    """First row per key within the watermark; state older than that is dropped."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def dedup_batch(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """Batch body that appends only keys never stored before, for permanent dedup.

    Each batch owns one partition, overwritten when the batch is replayed, and
    is compared with the other batches only.
    """

    def body(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        fresh = batch.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*batch.columns)
        if number > 0:
            stored = spark.read.parquet(f"{path}/rows").where(F.col("batch") < number)
            fresh = fresh.join(stored.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return body


def split_dead_letters(path: str, attempts: str = "attempts", most: int = 3) -> Callable[[DataFrame, int], None]:
    """Batch body that sends rows with too many attempts to a second table."""

    def body(batch: DataFrame, number: int) -> None:
        dead = F.col(attempts) > most
        batch.where(~dead).write.mode("overwrite").parquet(f"{path}/live/batch={number}")
        batch.where(dead).write.mode("overwrite").parquet(f"{path}/dead/batch={number}")

    return body


def stream_throughput(stream: DataFrame, ts: str, length: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per tumbling or sliding window, late rows accepted up to the watermark."""
    frame = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(frame.alias("w")).agg(F.count("*").alias("docs")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "docs"
    )


def session_hits(stream: DataFrame, user: str, ts: str, gap: str = "60 seconds", late: str | None = None) -> DataFrame:
    """Hits per user session: a key that expires ``gap`` after its last hit."""
    rows = stream.withWatermark(ts, late) if late else stream
    return rows.groupBy(F.col(user).alias("user"), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("hits")).select(
        "user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "hits"
    )


def _replay(times: list, count: int, last: float | None, limit: int, ttl: float) -> tuple[list[bool], int, float | None]:
    """Decisions for ordered hit times, continuing from (count, time of the last accepted hit)."""
    said = []
    for t in times:
        if last is None or t - last >= ttl:
            count = 0
        ok = count < limit
        if ok:
            count, last = count + 1, t
        said.append(ok)
    return said, count, last


def rate_limit_exact(stream: DataFrame, user: str, ts: str, event: str, limit: int = 100, ttl_seconds: float = 60.0) -> DataFrame:
    """(user, event, ts, accepted): at most ``limit`` hits per key that expires
    ``ttl_seconds`` after the last accepted hit; rejected hits do not renew it.

    The state per user is two numbers and is kept; rows of one batch are taken
    in time order, and batches in the order they arrive.
    """

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event"], kind="stable")
        seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
        said, count, last = _replay(list(seconds), int(count), last, limit, ttl_seconds)
        state.update((count, last))
        yield rows.assign(user=key[0], accepted=said)[["user", "event", "ts", "accepted"]]

    rows = stream.select(F.col(user).alias("user"), F.col(event).alias("event"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.groupBy("user").applyInPandasWithState(
        decide, "user bigint, event bigint, ts timestamp, accepted boolean", "count long, last double", "append",
        GroupStateTimeout.NoTimeout,
    )


def stall_alerts(stream: DataFrame, doc: str, ts: str, state_column: str, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(doc, claimed_at): claims without a finish within ``minutes``, by event time.

    A claim sets a timer; the finish clears it; the alert fires once the
    watermark has passed the timer.
    """

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (claimed,) = state.get
            state.remove()
            yield pd.DataFrame({"doc": [key[0]], "claimed_at": pd.to_datetime([claimed], unit="us")})
            return
        limit = minutes * 60_000_000
        claimed = state.get[0] if state.exists else None
        rows = pd.concat(list(batches))
        order = (rows["kind"] == "processing").astype(int)
        rows = rows.assign(us=rows["ts"].astype("datetime64[us]").astype("int64"), order=order).sort_values(["us", "order"])
        alerts = []
        for us, kind in zip(rows["us"], rows["kind"]):
            if claimed is not None and us - claimed >= limit:
                alerts.append(claimed)
                claimed = None
            if kind == "processing":
                claimed = us if claimed is None else claimed
            else:
                claimed = None
        if claimed is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(claimed),))
            state.setTimeoutTimestamp(max((claimed + limit) // 1000, state.getCurrentWatermarkMs() + 1))
        if alerts:
            yield pd.DataFrame({"doc": [key[0]] * len(alerts), "claimed_at": pd.to_datetime(alerts, unit="us")})

    rows = stream.select(F.col(doc).alias("doc"), F.col(ts).cast("timestamp").alias("ts"), F.col(state_column).alias("kind"))
    return rows.withWatermark("ts", late).groupBy("doc").applyInPandasWithState(
        watch, "doc bigint, claimed_at timestamp", "claimed long", "append", GroupStateTimeout.EventTimeTimeout
    )


def latest_status(stream: DataFrame, doc: str, ts: str, status: str) -> DataFrame:
    """Last state per document; run in update or complete mode."""
    return stream.groupBy(F.col(doc).alias("doc")).agg(
        F.max_by(status, F.struct(ts, status)).alias("status"), F.max(ts).alias("since"), F.count("*").alias("changes")
    )


def upsert_latest(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Batch body for update mode: keeps one current row per key.

    A batch rewrites the buckets of its own keys; a replayed batch that was
    committed changes nothing, and readers never see a half-written one.
    """

    def body(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # its buckets are asked for before its rows
        KeyedTable(batch.sparkSession, path, key).upsert(batch, replace(key), number)
        batch.unpersist()

    return body


def pipeline_batch(path: str, size: int = 6000, overlap: int = 500, label: str = "Person") -> Callable[[DataFrame, int], None]:
    """Batch body: route the text, chunk what is complete, extract names and link them to their documents.

    Routes, chunks, mentions and edges are one partition per batch, overwritten
    when it is replayed; nodes are a keyed table, one row per label and name.
    """
    from corpusgraph.functions.text import route_extraction
    from corpusgraph.operators.chunking import assign_point_ids, chunk_text
    from corpusgraph.operators.extraction import capitalized_runs
    from corpusgraph.operators.graph import MENTIONED, node_id

    def body(batch: DataFrame, number: int) -> None:
        routed = batch.withColumn("route", route_extraction(F.col("text")))
        done = routed.where(F.col("route") == "completed")
        out = {
            "routes": routed.select("doc_id", "route"),
            "chunks": assign_point_ids(chunk_text(done.select("doc_id", "text"), size=size, overlap=overlap)),
            "mentions": capitalized_runs(done),
        }
        for name, rows in out.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        found = batch.sparkSession.read.parquet(f"{path}/mentions/batch={number}")
        document = F.col("doc_id").cast("string")
        ends = found.select(
            node_id(F.lit(label), F.col("name")).alias("src"), node_id(F.lit("Document"), document).alias("dst"),
            F.lit(MENTIONED).alias("type"), F.col("mention_count").alias("count"), "name", document.alias("document"),
        )
        ends.select("src", "dst", "type", "count").write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
        nodes = ends.select(F.inline(F.array(
            F.struct(F.col("src").alias("id"), F.lit(label).alias("label"), "name"),
            F.struct(F.col("dst").alias("id"), F.lit("Document").alias("label"), F.col("document").alias("name")),
        ))).distinct()
        KeyedTable(batch.sparkSession, f"{path}/nodes", "id").upsert(nodes, replace("id"), number)

    return body


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The table kept by ``upsert_latest``."""
    return KeyedTable(spark, path).read()
