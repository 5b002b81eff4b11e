"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has several places on a ring. A key starts at the ring point of its
hash and goes to the next shard clockwise; a full shard's overflow continues
clockwise to the next distinct one. Keys of a ring point share that walk, so
the placement needs only the counts per point: a table of fixed size, whatever
the data. Rows then find their place by their rank within the point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ring points, and parts of a point that keep the rows of one key apart.
POINTS = 1 << 14
PARTS = 8
#: Places of a shard on the ring.
VIRTUAL = 64


def walks(shards: int, virtual: int = VIRTUAL) -> np.ndarray:
    """``POINTS`` rows: the distinct shards met clockwise from each ring point."""
    places = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") % POINTS, xxhash.xxh64_intdigest(f"{s}/{v}/tie"), s) for s in range(shards) for v in range(virtual))
    out = np.zeros((POINTS, shards), np.int64)
    walk: list[int] = []
    # From the last place back, the walk of a place is its shard before the others' order.
    for _, _, s in reversed(places):
        walk = [s, *(x for x in walk if x != s)]
    at = len(places) - 1
    for point in range(POINTS - 1, -1, -1):
        while at >= 0 and places[at][0] >= point:
            s = places[at][2]
            walk = [s, *(x for x in walk if x != s)]
            at -= 1
        out[point] = walk
    return out


def capacities(total: int, shards: int, slack: float) -> np.ndarray:
    """Most rows per shard. Without slack they sum to ``total``, so every shard is full."""
    if slack:
        return np.full(shards, -(-int(np.ceil((1 + slack) * total)) // shards), np.int64)
    return np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)


def place(counts: pd.DataFrame, shards: int, slack: float = 0.0, virtual: int = VIRTUAL) -> pd.DataFrame:
    """``point, part, low, high, shard, base``: ranks low..high of a cell go to ``shard`` from slot ``base``.

    In round r every overflowing cell offers its rest to the r-th shard of its
    walk; a shard takes cells in ring order until it is full.
    """
    counts = counts.sort_values(["point", "part"]).reset_index(drop=True)
    steps = walks(shards, virtual)[counts["point"].to_numpy(np.int64)] if len(counts) else np.zeros((0, shards), np.int64)
    left, done = counts["n"].to_numpy(np.int64).copy(), np.zeros(len(counts), np.int64)
    room = capacities(int(left.sum()), shards, slack)
    used = np.zeros(shards, np.int64)
    out = []
    for r in range(shards):
        if not left.any():
            break
        for s in range(shards):
            at = np.flatnonzero((steps[:, r] == s) & (left > 0))
            if not len(at):
                continue
            ends = np.minimum(np.cumsum(left[at]), room[s] - used[s])
            take = np.diff(ends, prepend=0)
            got = take > 0
            rows, take, first = at[got], take[got], used[s] + (ends - np.diff(ends, prepend=0))[got]
            out.append(pd.DataFrame({"cell": rows, "low": done[rows], "high": done[rows] + take - 1, "shard": s, "base": first}))
            done[rows] += take
            left[rows] -= take
            used[s] += take.sum()
    plan = pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("cell", "low", "high", "shard", "base")})
    plan["point"], plan["part"] = counts["point"].to_numpy()[plan["cell"]], counts["part"].to_numpy()[plan["cell"]]
    return plan[["point", "part", "low", "high", "shard", "base"]].astype("int64")


def shard_rows(docs: DataFrame, shards: int = 16, key: str = "doc_id", slack: float = 0.0, virtual: int = VIRTUAL) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Without ``slack`` the shards' row counts differ by one at most; with it no
    shard exceeds (1 + slack) times the mean, and fewer rows leave the first
    shard of their walk. Where a row lies follows from its key's hash and the
    counts per ring point alone. A null key is a key like others; rows of one
    key are kept apart by their other columns, so a hot key is spread over
    ``PARTS`` tasks, and whole-row copies are interchangeable. Columns named
    ``shard`` or ``slot`` are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot")
    spark = docs.sparkSession
    hashed = F.xxhash64(F.col(key))
    cell = {
        "_point": F.shiftrightunsigned(hashed, 64 - (POINTS.bit_length() - 1)),
        "_part": F.pmod(F.xxhash64(*docs.columns), F.lit(PARTS)),
    }
    rows = docs.withColumns(cell)
    # At most POINTS * PARTS rows, however many documents there are.
    counts = rows.groupBy(F.col("_point").alias("point"), F.col("_part").alias("part")).agg(F.count("*").alias("n")).toPandas()
    plan = spark.createDataFrame(place(counts, shards, slack, virtual), "point long, part long, low long, high long, shard long, base long")
    rank = F.row_number().over(Window.partitionBy("_point", "_part").orderBy(F.xxhash64(*docs.columns), key)) - 1
    ranked = rows.withColumn("_rank", rank.cast("long"))
    meets = (ranked._point == plan.point) & (ranked._part == plan.part) & ranked._rank.between(plan.low, plan.high)
    return ranked.join(F.broadcast(plan), meets).withColumns({
        "shard": F.col("shard").cast("int"), "slot": F.col("base") + F.col("_rank") - F.col("low"),
    }).select(*docs.columns, "shard", "slot")
