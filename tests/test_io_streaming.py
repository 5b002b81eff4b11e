"""Exports, upserts and multi-batch streams."""

import random

import pandas as pd
from pyspark.sql import functions as F

from corpusgraph.sources import sinks
from corpusgraph.streaming import flows


def test_csv_quoting(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a,b.pdf", "s", None, None, 2.0, '<mark>x</mark> "q"', [("n1",), ("n2",)])],
        "filename string, source string, doc_type string, date timestamp, score double, snippet string, entities array<struct<name:string>>",
    )
    sinks.export_csv(rows, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    text = part.read_text(encoding="utf-8")
    assert text.startswith("﻿filename,source,") and '"x ""q"""' in text


def test_write_points_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "points")
    first = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1")], "point_id bigint, body string, indexed_at string")
    second = spark.createDataFrame([(2, "c", "t2"), (3, "d", "t2")], "point_id bigint, body string, indexed_at string")
    for rows in (first, second, second):
        sinks.write_points(spark, rows, path)
    assert {(r.point_id, r.body) for r in sinks.read_points(spark, path).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def drop(frames, folder):
    folder.mkdir()
    for i, frame in enumerate(frames):
        frame.to_parquet(folder / f"f{i}.parquet")


def test_streams_over_several_batches(spark, tmp_path):
    drop([pd.DataFrame({"key": ["a", "b", "a"], "n": [3, 1, 2]}), pd.DataFrame({"key": ["b", "c"], "n": [9, 5]})], tmp_path / "in")
    stream = flows.stream_ingest(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    out = str(tmp_path / "out")
    flows.each_batch(stream, out, flows.dedup_batch(out, "key", "n")).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted(r.key for r in rows) == ["a", "b", "c"]
    latest = str(tmp_path / "latest")
    status = flows.latest_status(stream, "key", "n", "n")
    flows.each_batch(status, latest, flows.upsert_latest(latest, "doc"), mode="update").awaitTermination()
    assert {(r.doc, r.since, r.changes) for r in flows.read_latest(spark, latest).collect()} == {("a", 3, 2), ("b", 9, 2), ("c", 5, 1)}


def test_rate_limit_across_batches(spark, tmp_path):
    rng = random.Random(8)
    base = pd.Timestamp("2024-01-01")
    hits = sorted((rng.randrange(3), rng.uniform(0, 4000)) for _ in range(300))
    rows = pd.DataFrame({
        "user_id": [u for u, _ in hits], "ts": [(base + pd.Timedelta(seconds=s)).floor("us") for _, s in hits], "event_id": range(300),
    }).sort_values("ts")
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    drop([rows.iloc[:150], rows.iloc[150:]], tmp_path / "in")
    stream = flows.stream_ingest(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    limited = flows.rate_limit_exact(stream, "user_id", "ts", "event_id", limit=3, ttl_seconds=60)
    flows.to_table(limited, str(tmp_path / "out")).awaitTermination()
    got = {r.event: r.accepted for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()}
    state = {}
    for u, ts, e in rows.itertuples(index=False):
        n, last = state.get(u, (0, None))
        if last is None or (ts - last).total_seconds() >= 60:
            n = 0
        ok = n < 3
        if ok:
            state[u] = (n + 1, ts)
        assert got[e] == ok


def test_stall_alerts(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    at = lambda m: base + pd.Timedelta(minutes=m)
    first = pd.DataFrame({"doc": [1, 2, 3], "ts": [at(0), at(0), at(5)], "kind": ["processing"] * 3})
    second = pd.DataFrame({"doc": [2, 3, 4], "ts": [at(10), at(50), at(300)], "kind": ["completed", "completed", "processing"]})
    for frame in (first, second):
        frame["ts"] = frame["ts"].astype("datetime64[us]")
    drop([first, second], tmp_path / "in")
    stream = flows.stream_ingest(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    flows.to_table(flows.stall_alerts(stream, "doc", "ts", "kind", 30), str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "rows")).select("doc", F.col("claimed_at").cast("string").alias("c")).collect()
    assert sorted((r.doc, r.c) for r in rows) == [(1, "2024-01-01 00:00:00"), (3, "2024-01-01 00:05:00")]


def test_streams_read_a_table_in_one_file_or_many(spark, tmp_path):
    from workload.streaming_queries import stream

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(7)], "doc_id bigint, text string")
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    for folder in ("one", "many"):
        out = str(tmp_path / f"out-{folder}")
        flows.to_table(stream(spark, str(tmp_path / folder), "documents"), out).awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/rows").collect()) == list(range(7))
