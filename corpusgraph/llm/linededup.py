"""Line dedup: Bloom filters of once-seen and twice-seen line hashes pick the suspects, which alone shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import BLANK, lower_ascii, mix, rows_of, stored

#: Hashes per filter segment, bits per hash, and probes per hash.
SEGMENT = 1 << 18
SEGMENT_BITS = SEGMENT * 16
PROBES = 4
#: Filters up to this size travel to every task; larger ones meet the hashes in a join.
BROADCAST_MB = 32


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return lower_ascii(F.trim(line, F.lit(BLANK)))


def lines_of(text: Column) -> Column:
    """A text's lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, lines``: per document its distinct long keys as (64-bit hash, SHA-256 digest)."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= least))
    pairs = F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("hash"), F.unhex(F.sha2(k, 256)).alias("digest")))
    return docs.filter("doc_id IS NOT NULL").select("doc_id", pairs.alias("lines")).filter(F.size("lines") > 0)


def spots(hashes: np.ndarray) -> np.ndarray:
    """Bit positions of each hash in its segment, ``PROBES`` columns."""
    # The segment comes from the hash itself, the positions from a second mix.
    h = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(SEGMENT_BITS)).astype(np.uint32)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(segments)).astype(np.int64)


def twice_filter(hashes: DataFrame, segments: int) -> DataFrame:
    """``segment, twice``: the merged bitmap of hashes that two documents may share.

    Every task fills a once-seen and a twice-seen filter from its own documents
    and hands on only the positions of set bits. Merging a segment carries: a
    bit that was set before and is set again moves into the twice-seen filter.
    A hash that many documents hold is sent once by each task.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Filters of one part of the task's hashes at a time, so memory is bounded.
        part, held = [], 0

        def flush() -> pa.RecordBatch:
            seen, counts = np.unique(np.concatenate(part), return_counts=True)
            seg, pos = segment_of(seen, segments), spots(seen)
            order = np.argsort(seg, kind="stable")
            seg, pos, many = seg[order], pos[order], counts[order] > 1
            names, starts = np.unique(seg, return_index=True)
            ends = np.append(starts[1:], len(seg))
            once = [np.unique(pos[s:e]).tobytes() for s, e in zip(starts, ends)]
            twice = [np.unique(pos[s:e][many[s:e]]).tobytes() for s, e in zip(starts, ends)]
            return pa.RecordBatch.from_pydict({"segment": pa.array(names, pa.int64()), "once": pa.array(once, pa.binary()), "twice": pa.array(twice, pa.binary())})

        for batch in batches:
            part.append(batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(part[-1])
            if held > 2_000_000:
                yield flush()
                part, held = [], 0
        if held:
            yield flush()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
        for o, t in zip(rows["once"], rows["twice"], strict=True):
            new = np.frombuffer(o, np.uint32)
            twice[new[once[new]]] = True
            twice[np.frombuffer(t, np.uint32)] = True
            once[new] = True
        return pd.DataFrame({"segment": [key[0]], "twice": [np.packbits(twice).tobytes()]})

    bits = hashes.select(F.transform("lines", lambda x: x.hash).alias("hashes")).mapInArrow(fill, "segment long, once binary, twice binary")
    return bits.groupBy("segment").applyInPandas(merge, "segment long, twice binary")


def _probe(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    pos = spots(hashes)
    return ((bitmap[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(axis=1)


def suspects(hashes: DataFrame, segments: int, broadcast_mb: int) -> DataFrame:
    """``doc_id, digest`` of the lines whose hash the twice-seen filter holds."""
    filters = stored(twice_filter(hashes, segments), "twice")
    flat = lambda df: df.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.digest")
    if segments * SEGMENT_BITS / 8 <= broadcast_mb * 1e6:
        held = hashes.sparkSession.sparkContext.broadcast({r.segment: r.twice for r in filters.collect()})

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            maps = {k: np.frombuffer(v, np.uint8) for k, v in held.value.items()}
            for whole in batches:
                for batch in rows_of(whole, 4096):
                    lines = batch.column("lines")
                    counts = np.diff(lines.offsets.to_numpy())
                    values = lines.flatten()
                    found = values.field("hash").to_numpy(zero_copy_only=False).view(np.uint64)
                    seg, keep = segment_of(found, segments), np.zeros(len(found), bool)
                    for s in np.unique(seg):
                        at = np.flatnonzero(seg == s)
                        keep[at] = _probe(maps[s], found[at])
                    ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), counts)[keep]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "digest": values.field("digest").filter(pa.array(keep))})

        return hashes.mapInArrow(pick, "doc_id long, digest binary")

    # Beyond the bound each segment's filter meets its hashes, a segment's rows in bounded parts.
    @F.pandas_udf("long")
    def segment(h: pd.Series) -> pd.Series:
        return pd.Series(segment_of(h.to_numpy().view(np.uint64), segments))

    rows = hashes.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.hash", "x.digest", segment("x.hash").alias("segment"))
    most = rows.groupBy("segment").count().agg(F.max("count")).first()[0]
    parts = -(-most // SEGMENT)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def held_in(lines: pd.DataFrame, bitmap: pd.DataFrame) -> pd.DataFrame:
        if lines.empty or bitmap.empty:
            return lines[["doc_id", "digest"]].iloc[:0]
        keep = _probe(np.frombuffer(bitmap["twice"].iloc[0], np.uint8), lines["hash"].to_numpy().view(np.uint64))
        return lines.loc[keep, ["doc_id", "digest"]]

    keys = ["segment", "part"]
    return rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(held_in, "doc_id long, digest binary")


def repeated_lines(docs: DataFrame, least: int = 20, times: int = 3, keep: str = "last", broadcast_mb: int = BROADCAST_MB) -> DataFrame:
    """``doc_id, drops``: per document the digests of the line keys it loses.

    A key of at least ``least`` code points in at least ``times`` (2 or more)
    distinct doc_ids stays in the last of them (``keep="first"``: the first).
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    hashes = stored(line_hashes(docs, least), "line-hashes")
    total = hashes.agg(F.sum(F.size("lines"))).first()[0] or 0
    segments = max(1, -(-total // SEGMENT))
    found = suspects(hashes, segments, broadcast_mb).distinct()
    found = stored(found, "suspects")
    pick = F.max if keep == "last" else F.min
    # Exact: counted on digests of whole keys, so a Bloom hit alone drops nothing.
    confirmed = found.groupBy("digest").agg(F.count("*").alias("n"), pick("doc_id").alias("stays")).filter(F.col("n") >= times)
    lost = found.join(confirmed, "digest").filter("doc_id <> stays")
    return lost.groupBy("doc_id").agg(F.collect_list("digest").alias("drops"))


def dedup_lines(docs: DataFrame, least: int = 20, times: int = 3, keep: str = "last", broadcast_mb: int = BROADCAST_MB) -> DataFrame:
    """``docs`` with ``text`` after line dedup and new columns ``n_lines``, ``n_dropped``.

    Lines end at \\n; a null or empty text is one empty line and becomes an
    empty text. A line's key is the line without blanks at both ends, A-Z
    lower-cased. All lines of a key that was found in ``times`` documents go,
    except in the document that keeps it, where all stay. Rows that repeat a
    doc_id count as one document and are treated alike. A row without doc_id
    counts as no document and loses nothing. Other columns pass through; ones
    named like the new columns are replaced. Empty tables give empty results.
    """
    drops = repeated_lines(docs, least, times, keep, broadcast_mb)
    split = docs.drop("n_lines", "n_dropped").join(drops, "doc_id", "left")
    digest = lambda line: F.unhex(F.sha2(line_key(line), 256))
    lines = lines_of(F.col("text"))
    rest = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(lines, lambda x: ~((F.length(line_key(x)) >= least) & F.array_contains(F.col("drops"), digest(x)))))
    return (
        split.withColumn("rest", rest)
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.col("n_lines") - F.size("rest"))
        .withColumn("text", F.array_join("rest", "\n"))
        .drop("drops", "rest")
    )
