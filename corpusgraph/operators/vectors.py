"""Nearest neighbours and bookkeeping over embedding points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.similarity import cosine_to

# Scores are compared to so many places: beyond them the order of a sum shows.
PLACES = 12
#: Pairs of blocks that keep a cluster busy, points per slice of a block, and candidates per result that are scored one by one.
PAIRS, SLICE, MANY = 64, 128, 64


def filtered(points: DataFrame, people_count: int | None = None, **equals) -> DataFrame:
    """The points with the given payload values, and at least so many people."""
    for column, value in equals.items():
        points = points.where(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return points if people_count is None else points.where(F.col("people_count") >= people_count)


def knn(points: DataFrame, vector: list[float], k: int = 10, threshold: float | None = None,
        people_count: int | None = None, **equals) -> DataFrame:
    """The ``k`` most similar points by cosine, filters applied before scoring.

    ``equals`` are exact-match payload filters; each task keeps only its own
    best ``k`` rows, so nothing but those is shuffled.
    """
    points = filtered(points, people_count, **equals)
    scored = points.withColumn("score", F.round(cosine_to(vector, F.col("embedding")), PLACES)).where("score IS NOT NULL")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.drop("embedding").orderBy(F.desc("score"), "point_id").limit(k)


def vector_of(points: DataFrame, document_id) -> list[float]:
    """The stored vector of one document (its first point); raises when there is none."""
    row = points.where(F.col("document_id") == document_id).orderBy("point_id").select("embedding").first()
    if row is None:
        raise LookupError(f"no vector for document {document_id}")
    return list(row.embedding)


def similar_to(points: DataFrame, document_id, k: int = 10, **equals) -> DataFrame:
    """Points nearest to a stored document, that document excluded."""
    others = points.where(F.col("document_id") != document_id)
    return knn(others, vector_of(points, document_id), k, **equals)


def knn_batch(points: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = False,
              point_block: int = 20_000, query_block: int = 2_000) -> DataFrame:
    """The ``k`` nearest points of every query, exactly, for tables of any size.

    Points and queries are cut into blocks of bounded size by hash; every pair
    of blocks is one matrix product that emits only the best ``k`` per query.
    Neither side is broadcast or collected.  ``queries`` is (query_id, embedding).
    Query blocks grow from ``query_block`` to ``point_block`` with the tables,
    once there are ``PAIRS`` pairs of blocks, so that rows are copied less often.
    Single precision finds the few points that can be among the best of a
    block; these are scored in double precision.
    """
    sizes = points.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n_queries = queries.count()
    dim = sizes.d or 1
    p_blocks = max(1, math.ceil(sizes.n / point_block))
    q_blocks = max(1, math.ceil(n_queries / max(point_block, query_block)), min(math.ceil(n_queries / query_block), math.ceil(PAIRS / p_blocks)))
    # Each side carries its own block and is repeated once per block of the other.
    left = points.select(
        F.pmod(F.xxhash64("point_id"), F.lit(p_blocks)).alias("pb"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"),
        "point_id", "embedding",
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(p_blocks - 1)).cast("array<bigint>")).alias("pb"),
        F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb"),
        "query_id", "embedding",
    )

    def unit(column: pd.Series) -> np.ndarray:
        rows = [v if v is not None and len(v) == dim else np.full(dim, np.nan) for v in column]
        m = np.asarray(rows, dtype="float64").reshape(len(rows), dim)
        with np.errstate(invalid="ignore", divide="ignore"):
            return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(pts: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(qs):
            return pd.DataFrame({"query_id": [], "point_id": [], "score": []})
        pts = pts.sort_values("point_id")
        targets, wanted = unit(pts["embedding"]), unit(qs["embedding"])
        sound, asking = np.isfinite(targets).all(axis=1), np.isfinite(wanted).all(axis=1)
        ids, targets = pts["point_id"].to_numpy()[sound], targets[sound]
        asked, wanted = qs["query_id"].to_numpy()[asking], wanted[asking]
        out = [pd.DataFrame({"query_id": [], "point_id": [], "score": []})]
        if not len(ids):
            return out[0]
        rough_targets = targets.T.astype("float32")
        for lo in range(0, len(asked), 256):
            mine, units = asked[lo : lo + 256], wanted[lo : lo + 256]
            rows, cols, scores = closest(mine, units, ids, targets, rough_targets)
            out.append(pd.DataFrame({"query_id": mine[rows], "point_id": ids[cols], "score": scores}))
        return pd.concat(out[1:] or out)

    def closest(mine: np.ndarray, units: np.ndarray, ids: np.ndarray, targets: np.ndarray, rough_targets: np.ndarray):
        """Rows, columns and scores of the best ``k`` points of each query, in order."""
        rough = units.astype("float32") @ rough_targets
        if exclude_self:
            rough[mine[:, None] == ids[None, :]] = -np.inf
        starts = np.arange(0, len(ids), SLICE)
        least = np.full(len(mine), -np.inf, "float32")
        if len(starts) >= k:
            # The k-th best of the slices' bests is no better than the k-th best point.
            least = np.partition(np.maximum.reduceat(rough, starts, axis=1), len(starts) - k, axis=1)[:, len(starts) - k]
        # Each sum of products is off by less than half of this.
        margin = np.float32((dim + 8) * 2.0**-22)
        near = rough >= (least - margin)[:, None]
        near &= rough > -np.inf
        if np.count_nonzero(near) > MANY * len(mine) * max(k, 1):
            # Copies: too many are as near to be gathered one by one.
            scores = np.round(units @ targets.T, PLACES)
            scores[rough == -np.inf] = np.nan
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            picked = np.take_along_axis(scores, order, axis=1)
            rows, at = np.nonzero(np.isfinite(picked))
            return rows, order[rows, at], picked[rows, at]
        rows, cols = np.nonzero(near)
        scores = np.round(np.einsum("ij,ij->i", units[rows], targets[cols]), PLACES)
        order = np.lexsort((cols, -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return rows[first], cols[first], scores[first]

    found = left.groupBy("pb", "qb").cogroup(right.groupBy("pb", "qb")).applyInPandas(
        best, "query_id bigint, point_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_collections(collections: dict[str, DataFrame], vector: list[float], k: int = 10, **filters) -> DataFrame:
    """Search several collections, keep each document's best hit, return the overall best ``k``."""
    hits = None
    for name, points in collections.items():
        # Documents, not points, are cut to k, so near chunks of one document crowd out no other.
        found = best_chunks(filtered(points, **filters), vector, k).withColumn("collection", F.lit(name))
        hits = found if hits is None else hits.unionByName(found)
    # At most k rows per collection remain here.
    best = hits.groupBy("document_id").agg(
        F.max_by(F.struct("score", "collection", "point_id"), F.struct("score", -F.col("point_id"))).alias("best")
    )
    return best.select("document_id", "best.*").orderBy(F.desc("score"), "document_id").limit(k)


def best_chunks(points: DataFrame, vector: list[float], k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` best documents, each scored by its best chunk: (document_id, point_id, score)."""
    scored = points.withColumn("score", F.round(cosine_to(vector, F.col("embedding")), PLACES)).where("score IS NOT NULL")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    top = scored.groupBy("document_id").agg(F.max_by(F.struct("score", "point_id"), F.struct("score", -F.col("point_id"))).alias("b"))
    return top.select("document_id", "b.score", "b.point_id").orderBy(F.desc("score"), "document_id").limit(k)


def vector_distribution(points: DataFrame, column: str) -> DataFrame:
    """Vectors per payload value."""
    return points.groupBy(column).agg(F.count("*").alias("vectors"))


def validate_vectors(points: DataFrame, dim: int) -> DataFrame:
    """The points whose vector is missing or of the wrong size, with the reason."""
    size = F.size("embedding")
    error = F.when(F.col("embedding").isNull(), "missing").when(
        size != dim, F.concat(F.lit("dimension "), size.cast("string"))
    )
    return points.select("point_id", error.alias("error")).where("error IS NOT NULL")


def embed_status_rollup(chunks: DataFrame) -> DataFrame:
    """Per document: done chunks, failed chunks and the resulting status.

    ``chunks`` has (doc_id, ok); a document fails only when every chunk failed.
    """
    done = F.count_if("ok")
    total = F.count("*")
    return chunks.groupBy("doc_id").agg(
        done.alias("chunks_done"),
        (total - done).alias("chunks_failed"),
        F.when(done > 0, "completed").otherwise("failed").alias("status"),
        F.when(done == 0, F.concat(F.lit("all_chunks_failed ("), total.cast("string"), F.lit(" chunks)"))).alias("error"),
    )


def cost_estimate(points: DataFrame, tokens_each: int = 500, dollars_per_million: float = 0.02) -> DataFrame:
    """Vectors, tokens and price of embedding them once."""
    n = F.count("*")
    return points.agg(
        n.alias("vectors"),
        (n * tokens_each).alias("tokens"),
        F.round(n * tokens_each * F.lit(dollars_per_million) / 1_000_000, 6).alias("cost_usd"),
    )
