"""Stored inverted indexes: ranked words with block-max skipping, and trigrams.

Documents fall into segments of about ``SEGMENT`` by a hash of their id.  An
index row is a block: one word (or trigram) in one segment, with its sorted
documents.  So a word that every document holds has many rows of bounded size,
the blocks of several words meet by segment, and what a search needs to know
about a block, its size and largest count, is read without its documents.
Blocks lie in folders by a hash of their word and are sorted by it there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgraph.operators.search import STOP_WORDS, WORD_ENDS, like_pattern, query_terms, snippet
from corpusgraph.session import broadcast_if_small, spread

#: Documents per segment, and segments that a ranked search scores before it knows a threshold.
SEGMENT, SEEDS = 4096, 8
#: Ids that a filter names one by one, which lets the scan skip row groups.
LISTED = 1000
#: Stands before the first character of an anchored text.
START = "\x02"
BUCKETS = 256
#: Documents whose blocks in a folder are one task's work.
PIECE = 100_000


def _segment(doc: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(segments)).cast("int")


def _write(rows: DataFrame, key: str, path: str, documents: int, segments: int, blocks: DataFrame) -> None:
    spark = rows.sparkSession
    placed = blocks.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    # Ranges of words would compute the blocks twice, once for a sample. A folder's blocks are dealt by segment instead,
    # in pieces of so many documents: a frequent word is several tasks' work, a task writes to few folders.
    pieces = max(1, math.ceil(documents / PIECE))
    dealt = spread(placed.withColumn("piece", F.pmod("segment", F.lit(pieces))), "bucket", "piece", least=BUCKETS // 4 * pieces)
    sorted_blocks = dealt.drop("piece").sortWithinPartitions("bucket", key, "segment")
    sorted_blocks.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    spark.createDataFrame([(documents, segments, placed.schema.json())], "documents long, segments int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def _read(spark: SparkSession, path: str, key: str, wanted: list[str]) -> DataFrame:
    """The blocks of the wanted words: their folders, and there their row groups."""
    buckets = spark.createDataFrame([(w,) for w in wanted], "w string").select(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).distinct()
    columns = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/stats").first().columns))  # an empty index has no file that tells them
    return spark.read.schema(columns).parquet(f"{path}/blocks").where(F.col("bucket").isin([r.b for r in buckets.collect()]) & F.col(key).isin(wanted))


# Words


def write_block_index(docs: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Store the word index of ``docs`` (doc_id, text): blocks (token, segment, n, max_tf, docs, tfs)."""
    documents = docs.count()
    segments = max(1, math.ceil(documents / segment))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    # Texts are shuffled in place of their words: a segment's words are counted and gathered where its texts lie.
    placed = docs.where(F.col("text").isNotNull()).select("doc_id", F.split(F.lower("text"), WORD_ENDS).alias("words"), _segment(F.col("doc_id"), segments).alias("segment"))
    blocks = spread(placed, "segment", least=documents // SEGMENT).groupBy("segment").applyInArrow(gathered, f"token string, segment int, n long, max_tf int, docs array<{kind}>, tfs array<int>")
    _write(docs, "token", path, documents, segments, blocks)


def counted(rows: pa.RecordBatch) -> pa.Table:
    """(token, doc_id, tf) of rows (doc_id, words), each pair once; stop words and empty ones are left out."""
    words = rows.column("words")
    every = words.flatten().dictionary_encode()
    ids = rows.column("doc_id").dictionary_encode("encode")  # null and repeated ids are ids, too
    kept = pc.invert(pc.is_in(every.dictionary, pa.array(["", *STOP_WORDS], every.dictionary.type))).to_numpy(zero_copy_only=False)
    token, doc = every.indices.to_numpy(), ids.indices.to_numpy()[words.value_parent_indices().to_numpy()]
    here = kept[token]
    pairs, tf = np.unique(token[here].astype(np.int64) * len(ids.dictionary) + doc[here], return_counts=True)
    token, doc = np.divmod(pairs, max(1, len(ids.dictionary)))
    return pa.table({"token": every.dictionary.take(pa.array(token)), "doc_id": ids.dictionary.take(pa.array(doc)), "tf": tf})


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one segment (token, segment, n, max_tf, docs, tfs) from its rows (doc_id, words, segment)."""
    found, segment = None, None
    for rows in batches:
        part, segment = counted(rows), rows.column("segment")[:1]
        if found is not None:  # of a batch there stays no more than its counts
            part = pa.concat_tables([found, part]).group_by(["token", "doc_id"]).aggregate([("tf", "sum")]).rename_columns({"tf_sum": "tf"})
        found = part
    if found is None or not found.num_rows:
        return
    found = found.sort_by([("token", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    token, doc, tf = (found.column(c).combine_chunks() for c in ("token", "doc_id", "tf"))
    same = token.dictionary_encode().indices.to_numpy()
    first = np.concatenate(([0], np.flatnonzero(np.diff(same)) + 1))
    stop = np.append(first, len(same))
    counts = tf.to_numpy().astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(stop, pa.int32()), values) for values in (doc, pa.array(counts))]
    columns = [token.take(pa.array(first)), segment.take(pa.array(np.zeros(len(first), np.int64))), pa.array(np.diff(stop)), pa.array(np.maximum.reduceat(counts, first)), *lists]
    yield pa.RecordBatch.from_arrays(columns, names=["token", "segment", "n", "max_tf", "docs", "tfs"])


def ranked(spark: SparkSession, path: str, query: str, limit: int = 25, offset: int = 0) -> DataFrame:
    """(doc_id, score) of a page of the documents that hold all terms, as ``search.rank_documents`` scores them.

    The largest counts bound every segment's scores.  The segments with the
    highest bounds are scored first; their last wanted score rules out every
    segment whose bound lies below it.  What remains is scored exactly.
    """
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query holds only stop words")
    total = spark.read.parquet(f"{path}/stats").first().documents
    blocks = _read(spark, path, "token", terms)
    df = {r.token: r.df for r in blocks.groupBy("token").agg(F.sum("n").alias("df")).collect()}
    empty = spark.createDataFrame([], f"doc_id {dict(blocks.select(F.explode('docs').alias('d')).dtypes)['d']}, score double")
    if len(df) < len(terms):
        return empty
    # At most a query's words.
    idf = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, math.log(1 + total / df[t]))]), F.col("token"))

    def weight(tf: Column) -> Column:
        return (1 + F.log(tf)) * idf

    bounds = blocks.groupBy("segment").agg(F.count("*").alias("held"), F.sum(weight(F.col("max_tf"))).alias("bound")).where(F.col("held") == len(terms)).drop("held")

    def scored(segments: DataFrame) -> DataFrame:
        kept = blocks.join(segments, "segment", "left_semi")
        each = kept.select("token", F.inline(F.arrays_zip("docs", "tfs"))).select(F.col("docs").alias("doc_id"), weight(F.col("tfs")).alias("w"))
        return each.groupBy("doc_id").agg(F.count("*").alias("held"), F.round(F.sum("w"), 12).alias("score")).where(F.col("held") == len(terms)).drop("held")

    seeds = F.broadcast(bounds.orderBy(F.desc("bound"), "segment").limit(SEEDS).select("segment"))
    last = scored(seeds).orderBy(F.desc("score"), "doc_id").offset(offset + limit - 1).limit(1).collect()
    # Bounds and scores are rounded alike to within far less than this.
    open_segments = bounds.where(F.col("bound") >= last[0].score - 1e-9) if last else bounds
    page = scored(broadcast_if_small(open_segments.select("segment")))
    return page.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)


def _among(docs: DataFrame, found: DataFrame, key: str, most: int) -> DataFrame:
    """The rows of ``docs`` whose key is in ``found``; few keys become a filter that the scan can use."""
    ids = [r[0] for r in found.select(key).limit(min(most, LISTED) + 1).collect()]
    if len(ids) <= LISTED:
        return docs.where(F.col(key).isin(ids))
    return docs.join(broadcast_if_small(found.select(key)), key, "left_semi")


def fulltext(docs: DataFrame, path: str, query: str, limit: int = 25, offset: int = 0, width: int = 50, lead: int = 20) -> DataFrame:
    """``search.fulltext`` over all documents, answered from the stored index; texts are read for the page alone."""
    terms = query_terms(query)
    page = ranked(docs.sparkSession, path, query, limit, offset).collect() if limit <= LISTED else None
    page = docs.sparkSession.createDataFrame(page, f"doc_id {dict(docs.dtypes)['doc_id']}, score double") if page is not None else ranked(docs.sparkSession, path, query, limit, offset)
    shown = [c for c in docs.columns if c not in ("text", "extracted_text", "metadata")]
    rows = _among(docs, page, "doc_id", limit).join(broadcast_if_small(page), "doc_id")
    return rows.select(*shown, "score", snippet(F.col("text"), terms, width, lead).alias("snippet")).orderBy(F.desc("score"), "doc_id")


# Trigrams


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text, lower-cased."""
    # Matches of no width overlap; none begins with the second half of a character beyond the basic plane.
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"), F.lit(1)))


def _grams(text: str) -> list[str]:
    return list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))


def write_trigram_index(rows: DataFrame, key: str, text: str, path: str, anchored: bool = False, segment: int = SEGMENT) -> None:
    """Store which rows hold which trigrams: blocks (gram, segment, n, docs).

    ``anchored`` texts get two marks in front, so that a prefix of one
    character has a trigram, too.
    """
    count = rows.count()
    segments = max(1, math.ceil(count / segment))
    shown = F.concat(F.lit(START * 2), F.col(text)) if anchored else F.col(text)
    held = rows.select(F.col(key).alias("doc_id"), F.explode(trigrams(shown)).alias("gram"))
    blocks = held.groupBy("gram", _segment(F.col("doc_id"), segments).alias("segment")).agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    _write(rows, "gram", path, count, segments, blocks.select("gram", "segment", F.size("docs").cast("long").alias("n"), "docs"))


def candidates(spark: SparkSession, path: str, pattern: str, most: int = 3) -> DataFrame | None:
    """(doc_id) of the rows that hold the rarest ``most`` trigrams of a lower-case pattern; None if it has none."""
    grams = _grams(pattern)
    if not grams:
        return None
    blocks = _read(spark, path, "gram", grams)
    sizes = {r.gram: r.n for r in blocks.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    rare = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:most]
    found = None
    for g in rare:
        mine = blocks.where(F.col("gram") == g).select("segment", F.col("docs").alias("d"))
        found = mine if found is None else found.join(mine.withColumnRenamed("d", "e"), "segment").select("segment", F.array_intersect("d", "e").alias("d"))
    return found.select(F.explode("d").alias("doc_id"))


def containing(docs: DataFrame, path: str, name: str, key: str = "doc_id", text: str = "text", prefix: bool = False) -> DataFrame:
    """The rows whose text contains ``name`` (with ``prefix``: starts with it), ignoring case.

    Trigrams give the candidates and the texts decide.  A name of under three
    characters has no trigram: then the whole table is scanned, unless it is a
    prefix, whose index has marks in front of every text.
    """
    pattern = f"{like_pattern(name)}%" if prefix else f"%{like_pattern(name)}%"
    found = candidates(docs.sparkSession, path, (START * 2 if prefix else "") + name.lower())
    if found is not None:
        docs = _among(docs, found.withColumnRenamed("doc_id", key), key, LISTED)
    return docs.where(F.col(text).ilike(pattern))
