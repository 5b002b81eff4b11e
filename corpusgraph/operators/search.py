"""Full-text search, filters and paging over ``documents``.

``token_index`` is the stored inverted index: written sorted and bucketed by
token it lets a query read only its own postings.  Without an index the same
postings are computed from the text in the scan, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.binding import let

# Words too common to search for.
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i in is it its not of on or "
    "she that the their they this to was we were which will with you"
).split()

#: What stands between two words.
WORD_ENDS = r"[^\p{L}\p{N}]+"

MARK, UNMARK = "<mark>", "</mark>"


def tokenize(text: Column, stop: bool = True) -> Column:
    """Lower-case runs of letters and digits, in order."""
    words = F.split(F.lower(text), WORD_ENDS)
    skip = [""] + (STOP_WORDS if stop else [])
    return F.filter(words, lambda w: ~w.isin(skip))


def query_terms(query: str) -> list[str]:
    """Distinct search terms of a query string, in order."""
    import regex

    if not query.strip():
        raise ValueError("the search query is empty")
    words = regex.split(r"[^\p{L}\p{N}]+", query.lower())
    return list(dict.fromkeys(w for w in words if w and w not in STOP_WORDS))


def token_index(docs: DataFrame) -> DataFrame:
    """Inverted index rows (token, doc_id, tf, positions).

    The shuffle key is (token, doc_id), so a frequent token spreads over all
    partitions like any other.
    """
    tokens = tokenize(F.col("text"))
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    return (
        docs.select("doc_id", F.explode(placed).alias("p"))
        .groupBy(F.col("p.token").alias("token"), "doc_id")
        .agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("p.pos")).alias("positions"))
    )


def _bucket(token: str) -> str:
    return hashlib.md5(token.encode()).hexdigest()[:2]


def write_token_index(docs: DataFrame, path: str) -> None:
    """Store the index in 256 partitions by token hash, so a query prunes to its own.

    Each partition is written by several tasks, which keeps a frequent token
    from becoming one task's work; rows are sorted for row-group pruning.
    """
    index = token_index(docs).withColumn("bucket", F.substring(F.md5("token"), 1, 2))
    spread = index.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    spread.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, token, tf) of the terms, reading only their partitions."""
    wanted = index.where(F.col("token").isin(terms))
    if "bucket" in index.columns:
        wanted = wanted.where(F.col("bucket").isin(sorted({_bucket(t) for t in terms})))
    return wanted.select("doc_id", "token", "tf")


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, token, tf) straight from the text: counted per row, no shuffle."""

    def counts(hits: Column) -> Column:
        each = [
            F.struct(F.lit(q).alias("token"), F.size(F.filter(hits, lambda t: t == F.lit(q))).cast("bigint").alias("tf"))
            for q in terms
        ]
        return F.filter(F.array(*each), lambda s: s["tf"] > 0)

    hits = F.filter(tokenize(F.col("text")), lambda t: t.isin(terms))
    return docs.select("doc_id", F.inline(let(hits, counts)))


def rank_documents(found: DataFrame, terms: list[str], total: Column) -> DataFrame:
    """Documents holding every term, scored by tf–idf: sum of (1+ln tf)·ln(1+N/df).

    The document frequencies are one row per term, at most a query's length.
    """
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    weight = (1 + F.log("tf")) * F.log(1 + total / F.col("df"))
    return (
        found.join(F.broadcast(df), "token")
        .groupBy("doc_id")
        .agg(F.count("*").alias("matched"), F.round(F.sum(weight), 12).alias("score"))
        .where(F.col("matched") == len(terms))
        .drop("matched")
    )


def snippet(text: Column, terms: list[str], width: int = 50, lead: int = 20) -> Column:
    """A window of ``width`` words around the first hit with the hits marked."""
    def is_hit(word: Column) -> Column:
        # The tokeniser's rule: a hyphenated word holds several tokens.
        return F.exists(F.split(F.lower(word), r"[^\p{L}\p{N}]+"), lambda t: t.isin(terms))

    def window(words: Column) -> Column:
        first = F.array_position(F.transform(words, is_hit), F.lit(True))
        start = F.greatest(first - lead, F.lit(1).cast("bigint")).cast("int")
        return F.slice(words, start, F.lit(width))

    shown = F.transform(
        let(F.split(text, r"\s+"), window),
        lambda w: F.when(is_hit(w), F.concat(F.lit(MARK), w, F.lit(UNMARK))).otherwise(w),
    )
    return F.array_join(shown, " ")


def apply_filters(
    docs: DataFrame,
    sources: list[str] | None = None,
    doc_types: list[str] | None = None,
    classifications: list[str] | None = None,
    date_range: tuple | None = None,
    entity_ids: list | None = None,
    mentions: DataFrame | None = None,
) -> DataFrame:
    """The shared search filters; ``entity_ids`` keeps documents with *all* of them."""
    if sources:
        docs = docs.where(F.col("source").isin(sources))
    if doc_types:
        docs = docs.where(F.col("doc_type").isin(doc_types))
    if classifications:
        docs = docs.where(F.col("metadata")["content_classification"].isin(classifications))
    if date_range:
        docs = docs.where(F.col("created_at").between(F.lit(date_range[0]), F.lit(date_range[1])))
    if entity_ids:
        if mentions is None:
            raise ValueError("an entity filter needs the mentions table")
        docs = docs.join(documents_with_all(mentions, entity_ids), "doc_id", "left_semi")
    return docs


def documents_with_all(mentions: DataFrame, entity_ids: list) -> DataFrame:
    """Documents that mention every listed entity (relational division)."""
    wanted = list(dict.fromkeys(entity_ids))
    return (
        mentions.where(F.col("entity_id").isin(wanted))
        .groupBy("doc_id")
        .agg(F.countDistinct("entity_id").alias("n"))
        .where(F.col("n") == len(wanted))
        .select("doc_id")
    )


def fulltext(docs: DataFrame, query: str, limit: int = 25, offset: int = 0, index: DataFrame | None = None,
             corpus: DataFrame | None = None, width: int = 50, lead: int = 20) -> DataFrame:
    """Ranked documents that hold all query terms, with snippets for the page only.

    ``docs`` may be filtered; document frequencies are those of the filtered
    set unless ``corpus`` is given.
    """
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query holds only stop words")
    found = read_postings(index, terms).join(docs.select("doc_id"), "doc_id", "left_semi") if index is not None else postings(docs, terms)
    total = (corpus if corpus is not None else docs).agg(F.count("*").alias("n")).scalar()
    page = rank_documents(found, terms, total).orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)
    shown = [c for c in docs.columns if c not in ("text", "extracted_text", "metadata")]
    # The page is at most ``offset + limit`` rows, which bounds the broadcast.
    return (
        docs.join(F.broadcast(page), "doc_id")
        .select(*shown, "score", snippet(F.col("text"), terms, width, lead).alias("snippet"))
        .orderBy(F.desc("score"), "doc_id")
    )


def matching(docs: DataFrame, query: str) -> DataFrame:
    """Unranked documents that hold all query terms: a pure filter on the scan."""
    tokens = tokenize(F.col("text"))
    cond = F.lit(True)
    for term in query_terms(query):
        cond = cond & F.array_contains(tokens, term)
    return docs.where(cond)


def capped_count(rows: DataFrame, cap: int = 10_001) -> DataFrame:
    """Row count that stops at ``cap``; each task stops early."""
    return rows.limit(cap).agg(F.count("*").alias("count"))


def paginate(rows: DataFrame, order: list, page: int = 1, limit: int = 25) -> DataFrame:
    """One page of a totally ordered result; ``coerce_page`` makes the arguments of what a caller sends."""
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


def like_pattern(term: str) -> str:
    """``term`` as a literal for LIKE."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def substring_search(docs: DataFrame, name: str, limit: int = 25) -> DataFrame:
    """Documents whose text contains the name, hyphens read as blanks."""
    shown = name.replace("-", " ")
    return (
        docs.where(F.col("text").ilike(f"%{like_pattern(shown)}%"))
        .select("doc_id", "filename", "source", F.substring("text", 1, 500).alias("text_preview"))
        .orderBy("doc_id")
        .limit(limit)
    )


def substring_count(docs: DataFrame, name: str) -> DataFrame:
    """How many documents contain the name, and in which sources."""
    shown = name.replace("-", " ")
    return docs.where(F.col("text").ilike(f"%{like_pattern(shown)}%")).agg(
        F.count("*").alias("documents"), F.array_sort(F.collect_set("source")).alias("sources")
    )


def autocomplete(entities: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Entities whose name starts with the prefix, ignoring case, in name order."""
    return entities.where(F.col("canonical_name").ilike(f"{like_pattern(prefix)}%")).orderBy("canonical_name", "id").limit(limit)


def get_documents(docs: DataFrame, ids: list | None = None, filename: str | None = None) -> DataFrame:
    """Documents by id list or by file name."""
    if filename is not None:
        return docs.where(F.col("filename") == filename)
    return docs.where(F.col("doc_id").isin(list(ids or [])))


def get_documents_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose ids are in another table of any size."""
    return docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")


def search_nested(docs: DataFrame, query: str, field: str = "analysis", limit: int = 50) -> DataFrame:
    """Case-insensitive search in three nested fields of a JSON column."""
    pattern = f"%{like_pattern(query)}%"
    cond = F.lit(False)
    for key in ("extracted_text", "people_description", "context"):
        cond = cond | F.get_json_object(field, f"$.{key}").ilike(pattern)
    return docs.where(cond).orderBy("doc_id").limit(limit)


def year_range(docs: DataFrame, first: int, last: int, query: str | None = None, limit: int = 20) -> DataFrame:
    """Documents that mention a year of the range, optionally also matching a query."""
    from corpusgraph.functions.text import mentions_year

    rows = docs.where(mentions_year(F.col("text"), first, last))
    if query:
        rows = matching(rows, query)
    return rows.select("doc_id", "filename", "source").orderBy("doc_id").limit(limit)
