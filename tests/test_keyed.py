"""Keyed tables: which buckets change, what a failed writer leaves, replays and clean-up."""

import os

import pytest
from pyspark.sql import functions as F

from corpusgraph.sources.keyed import KeyedTable, replace
from corpusgraph.sources.sinks import read_points, write_points
from corpusgraph.streaming import flows


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def held(df):
    return sorted(map(tuple, df.collect()))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k", buckets=8)
    table.upsert(rows(spark, [(i, "a") for i in range(100)] + [(None, "n")]), replace("k"))
    before = table.manifest()
    table.upsert(rows(spark, [(5, "b"), (777, "c")]), replace("k"))
    after = table.manifest()
    changed = {b for b in after.buckets if after.buckets[b] != before.buckets.get(b)}
    assert after.version == 1 and 1 <= len(changed) <= 2
    want = {i: "a" for i in range(100)} | {5: "b", 777: "c", None: "n"}
    assert {r.k: r.v for r in table.read().collect()} == want
    assert {r.k: r.v for r in table.read(0).collect()} == {i: "a" for i in range(100)} | {None: "n"}
    assert {r.k: r.v for r in KeyedTable(spark, str(tmp_path)).read().collect()} == want


def test_a_writer_that_stops_before_the_commit_leaves_the_old_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k", buckets=4)
    table.upsert(rows(spark, [(i, "a") for i in range(20)]), replace("k"))
    old = held(table.read())
    staged = table.stage(rows(spark, [(i, "lost") for i in range(20)]), replace("k"))
    assert held(table.read()) == old and staged.version == 1
    table.upsert(rows(spark, [(3, "b")]), replace("k"))  # the next attempt takes the same number
    assert held(table.read()) == sorted([(i, "a") for i in range(20) if i != 3] + [(3, "b")])
    with pytest.raises(RuntimeError):
        table._commit(staged)


def test_replayed_batches_and_expired_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    body = flows.upsert_latest(path, "k")
    for number, v in ((0, "a"), (1, "b"), (1, "replayed"), (2, "c"), (3, "d"), (3, "again")):
        body(rows(spark, [(i, v) for i in range(number, 12)]), number)
    want = [(0, "a"), (1, "b"), (2, "c")] + [(i, "d") for i in range(3, 12)]
    assert held(flows.read_latest(spark, path)) == want
    table = KeyedTable(spark, path)
    assert table._versions() == [2, 3]
    named = {(m.buckets[b], b) for m in map(table.manifest, (2, 3)) for b in m.buckets}
    left = {(int(v), d.removeprefix("bucket=")) for v in os.listdir(f"{path}/data") for d in os.listdir(f"{path}/data/{v}") if d.startswith("bucket=")}
    assert left == named


def test_points_and_nothing(spark, tmp_path):
    point = lambda *r: spark.createDataFrame(r, "point_id long, label int, indexed_at string")
    path = str(tmp_path)
    write_points(spark, point((1, 1, "2"), (2, 2, "2"), (2, 3, "1")), path)
    write_points(spark, point((2, 9, "3")), path)
    write_points(spark, point((2, 9, "3")).where(F.lit(False)), path)
    assert held(read_points(spark, path)) == [(1, 1, "2"), (2, 9, "3")]
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, str(tmp_path / "none")).read()
