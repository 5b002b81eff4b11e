"""Vector code compression: product codes by exact integer k-means.

Vectors become integers and are cut into equal parts; each part is told by the
number of its nearest codebook entry. Squared distances come from dot products,
and these from BLAS: integers are broken into limbs so narrow that a float64
product over a whole part stays within 2^53 and is exact, and the limb products
are recombined in int64. So codes do not depend on the order of summation, on
the batch or on the machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import common_length, finite, scaled, stored
from corpusgraph.session import broadcast_if_small

#: Rows whose distances to one codebook are held at a time.
ROWS = 4096


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Float64 arrays with ``x = sum(limb[i] << (width * i))`` and ``|limb| <= 2 ** width``."""
    out = []
    while x.size and np.abs(x).max() > 1 << width:
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact where the result fits int64."""
    width = (53 - max(1, a.shape[1] - 1).bit_length()) // 2
    total = np.zeros((len(a), len(b)), np.int64)
    high = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(high):
            total += (x @ y.T).astype(np.int64) << (width * (i + j))
    return total


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and part the nearest entry, the first at a tie, and its squared distance.

    ``x``: rows x dims; ``books``: parts x entries x width.
    """
    parts, _, width = books.shape
    code, gap = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        norm = np.einsum("ij,ij->i", books[p], books[p])
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS, p * width : (p + 1) * width]
            score = norm - 2 * products(part, books[p])
            first = code[at : at + ROWS, p] = score.argmin(axis=1)
            gap[at : at + ROWS, p] = score[np.arange(len(part)), first] + np.einsum("ij,ij->i", part, part)
    return code, gap


def sums(x: np.ndarray, code: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    """Adds every part of ``x`` to the sum and count of its entry."""
    parts, _, width = total.shape
    for p in range(parts):
        order = np.argsort(code[:, p], kind="stable")
        entry, start, n = np.unique(code[order, p], return_index=True, return_counts=True)
        total[p, entry] += np.add.reduceat(x[order, p * width : (p + 1) * width], start, axis=0)
        count[p, entry] += n


def largest(dims: int) -> int:
    """The largest component with which a sum of ``dims`` squared differences fits a long."""
    return isqrt((2**63 - 1) // dims) // 2


def kept(rows: DataFrame, key: str, vector: str, label: str | None, dims: int | None = None) -> DataFrame:
    """``vec_id, label, v`` of the usable rows."""
    tag = F.col(label) if label else F.lit(None).cast("int")
    df = rows.select(F.col(key).alias("vec_id"), tag.alias("label"), F.col(vector).alias("v")).filter(finite(F.col("v")))
    return df.filter(F.size("v") == dims) if dims else df


def fit_codebooks(
    rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding"
) -> np.ndarray | None:
    """Integer codebooks, parts x entries x width; None without a usable vector.

    They start from the ``entries`` smallest keys, nulls last, equal keys by
    their vectors, and there are fewer if there are fewer rows. A round is one
    pass over ``rows``, which is read anew each time: store it first if it is
    dear. Each task sends one row per used entry; entries are averaged with
    floor, unused ones stay.
    """
    base = kept(rows, key, vector, None)
    dims = common_length(base, "v")
    if dims is None:
        return None
    if dims % parts:
        raise ValueError(f"vectors of {dims} components do not cut into {parts} equal parts")
    spark, width, limit = rows.sparkSession, dims // parts, largest(dims)
    base = base.filter(F.size("v") == dims)
    first = base.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    books = scaled(first["v"].combine_chunks(), dims, scale, limit).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    cells = [f"s{i}" for i in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{c} long" for c in cells)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)

        def gather(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            now = held.value
            total, count = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
            for b in batches:
                if b.num_rows:
                    x = scaled(b.column("v"), dims, scale, limit)
                    sums(x, nearest(x, now)[0], total, count)
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), *(pa.array(total[part, entry, i]) for i in range(width))],
                names=["part", "entry", "n", *cells],
            )

        told = base.select("v").mapInArrow(gather, schema).groupBy("part", "entry")
        means = told.agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in cells)).collect()
        books = books.copy()
        for r in means:
            books[r.part, r.entry] = [r[c] // r.n for c in cells]
        held.destroy()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(
    rows: DataFrame, books: np.ndarray, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str | None = None
) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits per part, and the squared distance to the coded vector."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries at most")
    dims, limit = parts * width, largest(parts * width)
    held = rows.sparkSession.sparkContext.broadcast(books)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, gap = nearest(scaled(b.column("v"), dims, scale, limit), held.value)
                text = [c.tobytes().hex() for c in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array(gap.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    base = kept(rows, key, vector, label, dims)
    kinds = dict(base.dtypes)
    return base.mapInArrow(tell, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(
    rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row.

    Null vectors, vectors with a null, NaN or infinite component, empty ones
    and those of another length than most take no part. Rows that repeat a key
    and rows without one are coded each; null labels count as one label; other
    columns are ignored. An empty table gives an empty result. A component too
    large for squared distances in 64 bits raises ``OverflowError``.
    """
    spark = rows.sparkSession
    books = fit_codebooks(rows, parts, entries, rounds, scale, key, vector)
    if books is None:
        return spark.createDataFrame([], f"vec_id {rows.schema[key].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(encode(rows, books, scale, key, vector, label), "codes")
    by_label = coded.groupBy(F.col("label").alias("tag")).agg(F.sum("error").alias("label_error"))
    whole = coded.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("tag")))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
