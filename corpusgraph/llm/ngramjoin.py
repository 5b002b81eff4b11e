"""N-gram Jaccard join by parity sketches.

Each shingle falls into one of P pieces of a document's sketch and flips (XORs)
its own bit pattern there. A shingle that only one of two documents has can
change one piece at most, so the number of differing pieces, and the Hamming
distance of a sketch with one bit per shingle, never exceed the symmetric
difference. Within a band of set sizes a link allows at most D differing
shingles; with more than D pieces a linked pair agrees in at least one whole
piece, which is an equality join. Agreeing pairs pass the Hamming bound and are
then verified on their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import Lately, components, discard, mix, rows_of, shingles, stored
from corpusgraph.session import broadcast_if_small

#: Bits per shingle of the sketch that bounds a pair's symmetric difference from
#: below, its least size, and the least and most that buckets carry of it.
BITS_PER_SHINGLE = 2
LEAST_BITS = 1024
LEAST_MINI, MINI_BITS = 512, 4096
#: Bucket keys that a member carries, so that a pair is told in few buckets.
LEAD = 8
#: Upper end over lower end of a size band.
BAND = 1.3
#: Rows of a bucket that one comparison cell takes at a time.
BLOCK = 2000


def most_apart(total: int, percent: int) -> int:
    """Largest symmetric difference of a linked pair whose set sizes sum to ``total``.

    A link needs 100 I >= percent (total - I), so I >= percent total / (100 + percent).
    """
    return total - 2 * -(-percent * total // (100 + percent))


@lru_cache(maxsize=4)
def bands(percent: int, most: int = 1 << 31) -> list[tuple[int, int, int]]:
    """``(first size, pieces, slack)`` of every band.

    A band has D + 1 + slack pieces. At least slack + 1 of them agree for a
    linked pair, so a document with at most ``slack`` empty pieces need not
    offer its empty ones: one agreeing piece is not empty.
    """
    out, low = [], 1
    while low < most:
        high = max(low + 1, int(low * BAND))
        top = 2 * (high - 1)
        apart = max(most_apart(t, percent) for t in range(max(0, top - 20), top + 1))
        slack = -(-4 * apart // 100) + 1 if apart else 0
        out.append((low, apart + 1 + slack, slack))
        low = high
    return out


def piece_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the pieces a document offers: in its own band, and in each band that a linkable larger set may lie in."""
    n = len(found)
    plan = bands(percent)
    k = int(np.searchsorted([b[0] for b in plan], n, "right")) - 1
    own = mix(found)
    keys = []
    while k < len(plan) and percent * plan[k][0] <= 100 * max(n, plan[k][0] if not keys else n):
        _, pieces, slack = plan[k]
        # The upper half of a hash picks the piece; hashes are sorted, so pieces are runs.
        edges = np.searchsorted(found, ((np.arange(1, pieces, dtype=np.uint64) << np.uint64(32)) // np.uint64(pieces)) << np.uint64(32))
        edges = np.concatenate(([0], edges))
        counts = np.diff(np.append(edges, n))
        value = np.zeros(pieces, np.uint64)
        full = counts > 0
        value[full] = np.bitwise_xor.reduceat(own, edges[full])
        keep = np.ones(pieces, bool) if (~full).sum() > slack else full
        tag = mix(np.arange(pieces, dtype=np.uint64) + np.uint64(k << 40) + np.uint64(1))
        keys.append(mix(value ^ tag)[keep])
        k += 1
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def parity_bits(found: np.ndarray) -> bytes:
    """One bit per shingle, XORed into a power of two of bits that grows with the set."""
    size = max(LEAST_BITS, 1 << (BITS_PER_SHINGLE * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def small_sketch(bits: bytes, n: int) -> bytes:
    """About half a bit per shingle of the sketch, enough to tell near from far."""
    return folded(bits, min(MINI_BITS, max(LEAST_MINI, 1 << (n // 2).bit_length())) // 8).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes that the same set has: halves XORed onto each other."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, node, twin, bits, mini`` per row; ``node`` names the shingle set.

    Copies met again in the same task carry no sketch: their set has given it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = Lately()
        for whole in batches:
            for batch in rows_of(whole):
                size, node, twin, bits, mini = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    found = shingles(text, words)
                    size.append(len(found))
                    name, other = names_of(found)
                    node.append(name), twin.append(other)
                    if name is None or not met_first(done, name, other):
                        bits.append(None), mini.append(None)
                        continue
                    bits.append(parity_bits(found)), mini.append(small_sketch(bits[-1], len(found)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(twin, pa.int64()), pa.array(bits, pa.binary()), pa.array(mini, pa.binary())],
                    names=["doc_id", "n_shingles", "node", "twin", "bits", "mini"],
                )

    schema = "doc_id long, n_shingles long, node long, twin long, bits binary, mini binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def offers(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, key``: the pieces that each shingle set offers.

    Straight into the shuffle: pieces are many times the sketches, and reading
    the texts twice costs less than keeping them. Copies met again in the same
    task offer nothing new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = Lately()
        for whole in batches:
            for batch in rows_of(whole):
                node, keys = [], []
                for text in batch.column("text").to_pylist():
                    found = shingles(text, words)
                    name, other = names_of(found)
                    if name is None or not met_first(done, name, other):
                        continue
                    keys.append(piece_keys(found, percent).view(np.int64))
                    node.append(np.full(len(keys[-1]), name, np.int64))
                if node:
                    yield pa.RecordBatch.from_pydict({"node": np.concatenate(node), "key": np.concatenate(keys)})

    return docs.select("text").mapInArrow(run, "node long, key long")


def names_of(found: np.ndarray) -> tuple[int | None, int | None]:
    """Two 64-bit names of a shingle set; the second shows if two sets share the first."""
    if not len(found):
        return None, None
    with np.errstate(over="ignore"):
        first, second = mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def met_first(done: Lately, name: int, other: int) -> bool:
    return bool(done.fresh(np.array([name]), np.array([other]))[0])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of sketch rows."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _near(sizes_a, sizes_b, gap, percent: int) -> np.ndarray:
    """Pairs whose sizes and sketch distance still allow a link."""
    small, total = np.minimum(sizes_a, sizes_b), sizes_a + sizes_b
    need = -(-percent * total // (100 + percent))
    return (gap <= total - 2 * need) & (need <= small)


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int, sketch: str = "bits") -> DataFrame:
    """The ``a, b`` of ``pairs`` that pass the size and Hamming bounds, by the sketch in column ``sketch``."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col(sketch).alias(f"s{c}"))

    @F.pandas_udf("boolean")
    def passes(na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        gap = [int(apart(folded(x, k), folded(y, k))) for x, y, k in zip(sa, sb, np.minimum(sa.str.len(), sb.str.len()), strict=True)]
        return pd.Series(_near(na.to_numpy(), nb.to_numpy(), np.array(gap, np.int64), percent))

    return pairs.join(side("a"), "a").join(side("b"), "b").filter(passes("na", "nb", "sa", "sb")).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose whole texts link, by counting shared shingles."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.join(ends, "node", "left_semi").select("node", "doc_id"), "ends")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if_small(wanted), "doc_id")
    # A doc_id given to several rows names several sets; the sketch tells which one is meant.
    texts = stored(texts.select("node", "text"), "texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_name = None, None
        for whole in batches:
            for batch in rows_of(whole):
                a, b, ok = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
                for x, y, tx, ty in zip(a, b, batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                    if kept_name != (x, tx):
                        kept, kept_name = shingles(tx, words), (x, tx)
                    other = shingles(ty, words)
                    both = len(np.intersect1d(kept, other, assume_unique=True))
                    ok.append(100 * both >= percent * (len(kept) + len(other) - both))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "ok": pa.array(ok, pa.bool_())})

    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    edges = stored(joined.mapInArrow(run, "a long, b long, ok boolean").filter("ok").select("a", "b").distinct(), "edges")
    discard(pairs, wanted, texts)
    return edges


def told_here(lead_a: np.ndarray, lead_b: np.ndarray, key: int) -> bool:
    """Whether a pair that shares the bucket ``key`` is told there."""
    both = np.intersect1d(lead_a, lead_b, assume_unique=True)
    return not len(both) or both[0] == key


def cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: members of one bucket, in different components, that pass the bounds.

    ``members`` has ``key, node, comp, n, mini, lead``; ``lead`` are the node's
    smallest keys. A pair whose leads meet is told only in the smallest bucket
    of both, any other pair in every bucket that it shares. A bucket of m rows is cut into
    ceil(m / BLOCK) blocks; each pair of blocks is a cell of its own, so no task
    holds a whole large bucket, and only pairs within the bounds are returned.
    """
    counted = members.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    mixed = counted.filter("c0 <> c1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("cut"))
    cells = (
        members.join(mixed, "key")
        .withColumn("at", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .select(F.xxhash64("key", F.least("at", "other"), F.greatest("at", "other")).alias("cell"), (F.col("at") != F.col("other")).alias("two"), "at", "key", "node", "comp", "n", "mini", "lead")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, told = None, Lately()
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cell = rows["cell"].to_numpy()
            # The last cell may go on in the next batch.
            end = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            rest = rows.slice(end)
            yield from near(rows.slice(0, end), told)
        if rest is not None:
            yield from near(rest, told)

    def near(rows: pa.Table, told: Lately) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        cell, two, at, key, node, comp, n = (rows[c].to_numpy() for c in ("cell", "two", "at", "key", "node", "comp", "n"))
        lead = rows["lead"].combine_chunks()
        ends, lead = lead.offsets.to_numpy(), lead.values.to_numpy()
        mini = rows["mini"].to_pylist()
        length = np.array([len(x) for x in mini])
        # Sketches of one length in one matrix; longer ones fold onto shorter ones.
        tables = {k: np.stack([folded(x, k) if len(x) >= k else np.zeros(k // 8, np.uint64) for x in mini]) for k in np.unique(length).tolist()}
        at_a = np.arange(len(cell) - 1)
        for step in range(1, len(cell)):
            at_a = at_a[at_a + step < len(cell)]
            at_a = at_a[cell[at_a] == cell[at_a + step]]
            if not len(at_a):
                return
            a, b = at_a, at_a + step
            pick = (comp[a] != comp[b]) & (~two[a] | (at[a] != at[b]))
            a, b = a[pick], b[pick]
            gap, least = np.zeros(len(a), np.int64), np.minimum(length[a], length[b])
            for k, table in tables.items():
                at_k = least == k
                gap[at_k] = apart(table[a[at_k]], table[b[at_k]])
            pick = _near(n[a], n[b], gap, percent)
            a, b = a[pick], b[pick]
            here = np.array([told_here(lead[ends[x] : ends[x + 1]], lead[ends[y] : ends[y + 1]], key[x]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
            a, b = a[here], b[here]
            low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            new = told.fresh(low, high)
            if new.any():
                yield pa.RecordBatch.from_pydict({"a": low[new], "b": high[new]})

    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(compare, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``.

    Two rows link when 100 * shared shingles >= percent * all shingles of both;
    ``component_id`` is the smallest doc_id reachable by links. Shingles are
    those of ``common.shingles`` over the whole text. Null, empty or blank
    texts have no shingles and link with nothing: their component is their own
    doc_id. Rows with equal sets are one node, so copies cost one row each.
    Extra columns of ``docs`` are ignored. A row without doc_id keeps a null
    component unless its set is shared. An empty table gives an empty result.
    """
    feats = stored(sketches(docs, words), "sketches")
    nodes = stored(
        feats.filter("bits IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("mini").alias("mini"), F.min("twin").alias("t0"), F.max("twin").alias("t1")),
        "nodes",
    )
    if nodes.filter("t0 <> t1").limit(1).count():
        raise RuntimeError("two shingle sets share a 64-bit name")
    # A bucket's rows are chained to its smallest node: no pairs within a bucket.
    bucket = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stars = stored(offers(docs, words, percent).withColumn("head", F.first("node").over(bucket)).filter("head <> node"), "stars")

    # First the links to bucket heads; most copies settle here.
    first = stars.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    edges = verified(near_pairs(first, nodes, percent, "mini"), nodes, docs, words, percent)
    comps = stored(components(edges), "comps")
    # Then whatever shares a bucket across components.
    members = stored(stars.select("key", "node").union(stars.select("key", F.col("head").alias("node"))).distinct(), "members")
    named = nodes.join(comps.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "n", "mini")
    leads = members.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAD).alias("lead"))
    more = verified(near_pairs(cross_pairs(members.join(named, "node").join(leads, "node"), percent), nodes, percent), nodes, docs, words, percent)
    # Links between components of the first step count once, however many copies they join.
    side = lambda c: named.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    joined = more.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    discard(stars, members)
    comps = components(edges.union(joined))
    discard(edges, more)

    # Names to smallest doc_id, over the nodes and then over the rows.
    least = feats.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"))
    tops = least.join(comps.withColumnRenamed("id", "node"), "node", "left").select("node", "low", F.coalesce("comp", "node").alias("comp"))
    lows = tops.groupBy("comp").agg(F.min("low").alias("component_id"))
    ids = tops.join(lows, "comp").select("node", "component_id")
    rows = feats.select("doc_id", "n_shingles", "node")
    return rows.join(ids, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; columns as given.

    Documents without shingles stay. Of rows that repeat one doc_id with a
    linked text all stay or go together.
    """
    found = jaccard_components(docs, words, percent)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
