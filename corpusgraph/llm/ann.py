"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations. A code is split into
substrings of eight bits, each indexed by its value. Two codes within Hamming
distance R of each other have, by the pigeonhole principle, a substring within
R // m, so probing those buckets retrieves every code within R. The radius is
learned too; the codes it admits are reranked on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import stored
from corpusgraph.llm.quality import bounded

#: Vectors that rotations and radius are fitted on, and rotations per code.
SAMPLE = 8_000
ROTATIONS = 2
#: Share of the sample's true neighbours that the radius must admit.
COVER = 0.97
#: Queries that one pass over the index serves; their vectors are what is broadcast.
QUERY_BLOCK = 4096
#: Rows of an index block, so that probing has something to save.
ROWS = 8192


@dataclass
class Codes:
    mean: np.ndarray
    turns: np.ndarray  # dims x bits
    radius: int

    @property
    def substrings(self) -> int:
        return self.turns.shape[1] // 8

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Rows of bytes, one byte per substring."""
        return np.packbits((unit - self.mean) @ self.turns > 0, axis=1)


def usable(vector: Column, dims: int | None = None) -> Column:
    """Finite, no null component, not zero, and of the wanted length."""
    ok = vector.isNotNull() & (F.size(vector) > 0)
    ok &= ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok & (F.size(vector) == dims) if dims else ok, F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def learn(sample: np.ndarray, rotations: int = ROTATIONS, k: int = 5, cover: float = COVER, seed: int = 7) -> Codes:
    """Rotations that bring the sample close to the corners of a cube, and the radius that covers its neighbours.

    Each rotation is refined by turns: signs for the rotation, then the best
    orthogonal map onto these signs. Bits are padded to whole substrings.
    """
    unit, rng = units(sample), np.random.default_rng(seed)
    mean = unit.mean(axis=0)
    dims = unit.shape[1]
    width = -(-dims // 8) * 8
    turns = []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0][:dims]
        for _ in range(25):
            signs = np.sign((unit - mean) @ turn)
            u, _, v = np.linalg.svd((unit - mean).T @ signs, full_matrices=False)
            turn = u @ v
        turns.append(turn)
    codes = Codes(mean, np.concatenate(turns, axis=1), 0)
    bits = np.unpackbits(codes.encode(unit), axis=1).astype(np.float32)
    ask = rng.permutation(len(unit))[:500]
    near = unit[ask] @ unit.T
    near[np.arange(len(ask)), ask] = -2
    top = np.argsort(-near, axis=1)[:, : min(k, len(unit) - 1)]
    gaps = np.abs(bits[ask][:, None, :] - bits[top]).sum(axis=2).ravel()
    codes.radius = int(np.quantile(gaps, cover)) if len(gaps) else codes.turns.shape[1]
    return codes


class MultiIndex:
    """A block of codes with one table per substring: rows ordered by that byte, and where each value starts."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, m = codes, codes.shape[1]
        self.words = np.ascontiguousarray(codes) if m % 8 else np.ascontiguousarray(codes).view(np.uint64)
        self.radius = radius
        # R = m r + a: a + 1 substrings are probed to r and the rest to r - 1.
        r, a = divmod(radius, m)
        spread = np.bitwise_count(np.arange(256, dtype=np.uint8))
        self.probes = [np.flatnonzero(spread <= (r if t <= a else r - 1)).astype(np.uint8) for t in range(m)]
        self.order = [np.argsort(codes[:, t], kind="stable") for t in range(m)]
        self.starts = [np.searchsorted(codes[o, t], np.arange(257)) for t, o in enumerate(self.order)]

    def within(self, code: np.ndarray) -> np.ndarray:
        """Rows whose code lies within the radius of ``code``: all of them."""
        hit = np.zeros(len(self.codes), bool)
        for t, probe in enumerate(self.probes):
            if not len(probe):
                continue
            value = np.sort(probe ^ code[t]).astype(np.int64)
            low, size = self.starts[t][value], self.starts[t][value + 1] - self.starts[t][value]
            total = int(size.sum())
            if total:
                at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
                hit[self.order[t][at]] = True
        rows = np.flatnonzero(hit)
        gap = np.bitwise_count(self.words[rows] ^ (code if self.words.dtype == np.uint8 else np.ascontiguousarray(code).view(np.uint64))).sum(axis=1, dtype=np.int64)
        return rows[gap <= self.radius]


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _probed(index: DataFrame, asked: DataFrame, codes: Codes, radius: int, k: int, dims: int, query_block: int) -> DataFrame | None:
    """``query_id, vec_id, score``: at least the ``k`` nearest rows within ``radius`` of each query; None without queries."""
    spark = index.sparkSession
    blocks = max(1, -(-asked.count() // query_block))
    found = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toPandas()
        if mine.empty:
            continue
        q = np.stack(mine["v"].to_numpy()).astype(np.float64)
        held = spark.sparkContext.broadcast((mine["vec_id"].to_numpy(np.int64), q, codes.encode(units(q)), radius))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q, qcodes, radius = held.value
            length = np.sqrt(np.einsum("ij,ij->i", q, q))
            best = np.full((len(ids), k), -np.inf)
            best_id = np.full((len(ids), k), np.iinfo(np.int64).max)

            def probe(parts: list[pa.RecordBatch]) -> None:
                rows = pa.Table.from_batches(parts).combine_chunks()
                vec_id = rows["vec_id"].to_numpy()
                x = _matrix(rows["v"].combine_chunks(), dims)
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                tables = MultiIndex(np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(x), -1), radius)
                for i in range(len(ids)):
                    at = tables.within(qcodes[i])
                    at = at[vec_id[at] != ids[i]]
                    if not len(at):
                        continue
                    score = np.einsum("ij,j->i", x[at], q[i]) / (norm[at] * length[i])
                    pool, pool_id = np.concatenate((best[i], score)), np.concatenate((best_id[i], vec_id[at]))
                    first = np.lexsort((pool_id, -pool))[:k]
                    best[i], best_id[i] = pool[first], pool_id[first]

            parts, n = [], 0
            for b in batches:
                for s in range(0, b.num_rows, ROWS):
                    parts.append(b.slice(s, ROWS))
                    n += parts[-1].num_rows
                    if n >= ROWS:
                        probe(parts)
                        parts, n = [], 0
            if n:
                probe(parts)
            full = np.isfinite(best)
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, full.sum(axis=1)), "vec_id": best_id[full], "score": best[full]})

        part = index.mapInArrow(search, "query_id long, vec_id long, score double")
        found = part if found is None else found.union(part)
    return found


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, codes: Codes | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, by cosine.

    ``queries`` and ``rows`` share ``key``; a query is no candidate of its own,
    by its key. Scores are cosines of the original vectors in double precision,
    ties go to the smaller key. Null and zero vectors, vectors with a null, NaN
    or infinite component or of another length than most, and null keys take no
    part. Rows that repeat a key count once each. Extra columns are ignored.
    Codes are learned on at most ``sample`` rows, every row is indexed, and
    queries are taken in blocks, one pass over the index each. Queries with
    fewer than ``k`` rows within the learned radius are asked again with twice
    the radius, up to all bits, so each gets ``k`` rows, or all candidates if
    there are fewer.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    pick = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = pick(rows).groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes.dims
    base = pick(rows).filter(F.size("v") == dims)
    if codes is None:
        some = bounded(base, sample, "vec_id").limit(2 * sample).toPandas()
        codes = learn(np.stack(some["v"].to_numpy()).astype(np.float64), k=k)
    learned = spark.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = learned.value.encode(units(_matrix(b.column("v"), dims)))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary()), b.column("v")], names=["vec_id", "code", "v"])

    kind = dict(base.dtypes)["v"]
    index = stored(base.mapInArrow(encode, f"vec_id long, code binary, v {kind}"), "code-index")
    asked = stored(pick(queries).filter(F.size("v") == dims), "queries")
    bits, radius, found = codes.turns.shape[1], codes.radius, None
    while True:
        near = _probed(index, asked, codes, min(radius, bits), k, dims, query_block)
        if near is None:
            break
        near = stored(near, "near")
        if radius >= bits:
            found = near if found is None else found.union(near)
            break
        got = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("got"))
        want = asked.groupBy("vec_id").agg((F.count("*") * k).alias("want"))
        short = stored(want.join(got, "vec_id", "left").filter("got IS NULL OR got < want").select("vec_id"), "short")
        near = near.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        found = near if found is None else found.union(near)
        asked = stored(asked.join(short, "vec_id", "left_semi"), "queries")
        radius = max(1, 2 * radius)
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
