"""Helpers shared by the pipeline operators: stored intermediates, text batches, components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.session import scratch_path

#: The white space of the contracts: space and \t \n \v \f \r.
BLANK = " \t\n\x0b\x0c\r"
#: Words kept in a worker's hash cache before it starts anew.
CACHE = 100_000


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on.

    A batch stands in the JVM, on its way and in the Python worker at once;
    with whole texts the default of 10 000 rows takes hundreds of megabytes.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The plan restarts from files that outlive any executor, and later readers
    see the same rows however often a task is repeated.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables whose last reader is done; others must not be given.

    Shuffle files go when the driver's collectors find that nothing holds their
    plan any more, which between long jobs may be late, so they are called.
    """
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        spark._jvm.System.gc()


class Lately:
    """Which pairs of numbers a task has met lately, in memory of a fixed size.

    A place for each hash holds the last pair there: what is found was met,
    what was met long ago may not be found. For leaving out repeats early.
    """

    def __init__(self, places: int = 1 << 18):
        self.held = np.zeros((places, 2), np.int64)
        self.used = np.zeros(places, bool)

    def fresh(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True for pairs not met lately; each is from now on."""
        pair = np.stack([a, b], axis=1).astype(np.int64)
        with np.errstate(over="ignore"):
            place = (mix(mix(pair[:, 0].astype(np.uint64)) ^ pair[:, 1].astype(np.uint64)) & np.uint64(len(self.used) - 1)).astype(np.int64)
        new = ~self.used[place] | (self.held[place] != pair).any(axis=1)
        self.used[place], self.held[place] = True, pair
        return new


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that few texts are Python strings at a time."""
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles.

    A-Z are lower-cased and words end at ``BLANK``. With fewer words than
    ``words`` the whole sequence is one shingle; no words give none.
    """
    # bytes.lower and bytes.split know ASCII only, which is the contract's rule.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    # Hashing anew is cheaper than looking words up: a corpus has ever new ones.
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(h))
    last = len(h) - width + 1
    out = np.full(last, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + last])
    return np.unique(out)


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """``id, comp`` for every node of ``edges`` (``a, b``); comp is the smallest id reachable.

    Each round takes the least label among neighbours and then jumps to the
    label's own label, so a chain halves per round. Labels and edges stay
    distributed; raises if ``most`` rounds do not settle it.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "labels")
    for _ in range(most):
        near = (
            both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        )
        step = labels.join(near, labels.id == near.a, "left").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        before, labels = labels, stored(step.join(up, "comp", "left").select("id", "old", F.least("comp", "top").alias("comp")), "labels")
        discard(before)
        if labels.filter("comp <> old").limit(1).count() == 0:
            discard(both)
            return labels.select("id", "comp")
        labels = labels.select("id", "comp")
    raise RuntimeError(f"components did not settle in {most} rounds")


def finite(vector: Column) -> Column:
    """True for a vector that is not null or empty and holds neither null nor NaN nor infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def common_length(rows: DataFrame, vector: str) -> int | None:
    """The length most vectors have, the smaller one at a tie; None without vectors."""
    sizes = rows.groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "dims").first()
    return None if most is None else most.dims


def scaled(column: pa.Array, dims: int, scale: int, limit: int) -> np.ndarray:
    """``floor(scale * x)`` of a batch of vectors, exact in double precision; raises beyond ``limit``."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64) * scale)
    if x.size and np.abs(x).max() > limit:
        raise OverflowError(f"a component times {scale} exceeds {limit}: results would not fit a long")
    return x.astype(np.int64)
