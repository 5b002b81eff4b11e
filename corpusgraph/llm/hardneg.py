"""Hard-negative mining with full exact scores from subset-sum tables.

The Four-Russians way: an anchor's components are taken eight at a time and
the sums of all 256 subsets of each eight are tabled. A candidate's integers
are laid out as bit planes, eight components to a byte. The byte of a plane and
group is the row of the table to add, the plane's place is the shift, and the
sign plane counts negative: the inner product comes from lookups, shifts and
additions alone, exact in integers.

Anchors are taken in blocks, one pass over the rows for the positives of a
block and one for its negatives. A task keeps the first few per anchor, so
what is shuffled does not grow with the rows a task reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import common_length, finite, scaled, stored

#: Anchors that one pass over the rows serves; their vectors are what is broadcast.
ANCHOR_BLOCK = 4096
#: Anchors whose tables, and rows whose scores, are held at a time.
TABLES, ROWS = 128, 4096
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """Groups x 256 x anchors: the sum of every subset of each eight components."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    whole = np.zeros((groups * 8, n), kind)
    whole[:dims] = anchors.T
    out = np.zeros((groups, 256, n), kind)
    for bit in range(8):
        half = 1 << bit
        out[:, half : 2 * half] = out[:, :half] + whole[bit::8][:, None, :]
    return out


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Planes x rows x groups of bytes of the two's complement of ``x``; the last plane is the sign's."""
    low, high = int(x.min()), int(x.max())
    planes = 1 + max(high, ~low if low < 0 else low, 0).bit_length()
    return np.stack([np.packbits((x >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)])


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Rows x anchors of inner products."""
    rows, anchors = planes.shape[1], tables.shape[2]
    total, plane = np.zeros((rows, anchors), tables.dtype), np.empty((rows, anchors), tables.dtype)
    sign = len(planes) - 1
    for p, group in enumerate(planes):
        plane[:] = 0
        for g, table in enumerate(tables):
            plane += table[group[:, g]]
        total += -(plane << p) if p == sign else plane << p
    return total


def best(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of every group, higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.r_[0, np.flatnonzero(np.diff(g)) + 1] if len(g) else np.empty(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[place < k]


def leading(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what can be among the first ``k`` allowed scores of its row, all ties included."""
    if score.shape[1] > k:
        shown = np.where(allowed, score, np.iinfo(score.dtype).min)
        allowed = allowed & (shown >= np.partition(shown, -k, axis=1)[:, -k, None])
    return np.nonzero(allowed)


def _searched(base: DataFrame, asked: dict[str, np.ndarray], dims: int, scale: int, limit: int, k: int) -> DataFrame:
    """``ask, vec_id, score``: the first ``k`` rows per task of every ask.

    ``asked`` holds the anchors (``v, ids, labels``) and the asks (``anchor``,
    ``same`` label or not, ``low`` and ``high`` score), ordered by anchor.
    """
    held = base.sparkSession.sparkContext.broadcast(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        top = int(np.abs(a["v"]).max()) if a["v"].size else 0
        found = [np.empty(0, np.int64)] * 3

        def against(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
            nonlocal found
            planes = bit_planes(x)
            # Every partial sum stays within the bound of the whole: twice the largest sum over all planes.
            kind = np.int32 if dims * top << (len(planes) + 1) < 2**31 else np.int64
            parts = [found]
            for at in range(0, len(a["v"]), TABLES):
                s = np.ascontiguousarray(scores(subset_sums(a["v"][at : at + TABLES], kind), planes).T)
                other = ids != a["ids"][at : at + TABLES, None]
                equal = labels == a["labels"][at : at + TABLES, None]
                first, last = np.searchsorted(a["anchor"], (at, at + TABLES))
                # Asks of equal rank among their anchor's asks are looked up together, one row of scores each.
                rank = np.arange(first, last) - np.searchsorted(a["anchor"], a["anchor"][first:last])
                for r in range(int(rank.max()) + 1 if last > first else 0):
                    ask = first + np.flatnonzero(rank == r)
                    row = a["anchor"][ask] - at
                    mine = s[row]
                    fit = other[row] & (equal[row] if a["same"] else ~equal[row])
                    fit &= (mine >= a["low"][ask, None]) & (mine <= a["high"][ask, None])
                    i, j = leading(mine, fit, k)
                    parts.append([ask[i], ids[j], mine[i, j].astype(np.int64)])
            merged = [np.concatenate(c) for c in zip(*parts)]
            keep = best(*merged, k)
            found = [c[keep] for c in merged]

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                s = b.slice(at, ROWS)
                against(s.column("vec_id").to_numpy(), s.column("label").to_numpy(), scaled(s.column("v"), dims, scale, limit))
        yield pa.RecordBatch.from_pydict({"ask": found[0], "vec_id": found[1], "score": found[2]}, schema=pa.schema([("ask", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    near = base.mapInArrow(search, "ask long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """Hard negatives of every anchor and positive, as ``RESULT`` tells.

    Components become ``floor(scale * x)``; a score is the inner product with
    the anchor. An anchor is a row where the condition ``anchors`` holds; its
    positives are its first ``positives`` other rows of the same label, and a
    pair's negatives the first ``negatives`` rows of another label with
    ``least * positive_score <= 100 * negative_score <= most * positive_score``.
    Higher scores come first, ties by smaller key.

    Rows with a null key, label or vector, with a null, NaN or infinite
    component, with an empty vector or one of another length than most take no
    part. A row that repeats is a candidate as often as it occurs, and as an
    anchor it gets its results as often; a row with the anchor's own key is
    never its candidate. Other columns are ignored; an empty table gives an
    empty result. Components whose scores could leave 64 bits raise
    ``OverflowError``.
    """
    spark = rows.sparkSession
    base = rows.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    dims = common_length(base, "v")
    if dims is None:
        return spark.createDataFrame([], RESULT)
    base = base.filter(F.size("v") == dims)
    # Scores, their running sums and 19/20 of them stay below 2^62.
    limit = int((2**62 / (max(100, least, most) * 4 * dims)) ** 0.5)
    asking = stored(base.filter("asks").select("vec_id", "label", "v", F.monotonically_increasing_id().alias("n")), "anchors")
    base = base.select("vec_id", "label", "v")
    blocks, found = -(-asking.count() // block), []
    place = F.pmod(F.xxhash64("n"), F.lit(max(1, blocks)))
    for number in range(blocks):
        got = asking.filter(place == number).toArrow()
        if not got.num_rows:
            continue
        ids, labels = got["vec_id"].to_numpy(), got["label"].to_numpy()
        x = scaled(got["v"].combine_chunks(), dims, scale, limit)
        wide = np.iinfo(np.int64)
        every = np.arange(len(ids))
        held = {"v": x, "ids": ids, "labels": labels}
        near = _searched(base, held | {"anchor": every, "same": True, "low": np.full(len(ids), wide.min), "high": np.full(len(ids), wide.max)}, dims, scale, limit, positives)
        pairs = near.orderBy("ask", "rank").toArrow()
        anchor, score = pairs["ask"].to_numpy(), pairs["score"].to_numpy()
        low, high = -((-least * score) // 100), (most * score) // 100
        hard = _searched(base, held | {"anchor": anchor, "same": False, "low": low, "high": high}, dims, scale, limit, negatives)
        told = pa.table({"ask": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": pairs["vec_id"].to_numpy(), "positive_score": score})
        named = hard.join(F.broadcast(spark.createDataFrame(told)), "ask")  # a block's pairs: block * positives rows at most
        found.append(stored(named.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], RESULT)
