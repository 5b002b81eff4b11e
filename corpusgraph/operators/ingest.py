"""Registration, exact deduplication and storage reconciliation.

All of these are equi-joins on a hash, a file name or a storage key.  Groups of
identical documents may be huge, so the keeper of a hash is found with a
partially aggregated ``min`` rather than a window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def import_documents(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Register a batch by ``content_hash``.

    Adds ``kept_id`` (the document that owns the content) and ``status``:
    ``inserted`` for the smallest id of unseen content, else ``duplicate``.
    A row without a hash is always inserted.
    """
    first = batch.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    known = existing.groupBy("content_hash").agg(F.min("doc_id").alias("known_id"))
    keeper = first.join(known, "content_hash", "left")
    owner = F.coalesce("known_id", "first_id", "doc_id")
    fresh = F.col("known_id").isNull() & (owner == F.col("doc_id"))
    return (
        batch.join(keeper, "content_hash", "left")
        .withColumn("kept_id", owner)
        .withColumn("status", F.when(fresh, "inserted").otherwise("duplicate"))
        .drop("first_id", "known_id")
    )


def _reopen(status: Column) -> Column:
    return F.when(status == "failed", "pending").otherwise(status)


def upsert_documents(existing: DataFrame, incoming: DataFrame, key: str = "filename", other: str | None = None) -> DataFrame:
    """Insert or update by ``key``, and where that is new, by the key ``other`` if given.

    A conflict takes the incoming storage key and reopens failed rows; every
    other stored value stays.  ``incoming`` must be unique on ``key``.  With
    ``other`` (say ``content_hash``), a row whose ``key`` is not stored meets
    the stored row of equal ``other``, the first by ``key`` of several; if
    several rows meet one, the last by ``key`` gives the storage key, unless a
    row of its own key does.  New rows of equal ``other`` become one: the first
    by ``key``, with the last one's storage key.
    """
    if other is not None:
        incoming = _settled(existing, incoming, key, other)
    extra = [c for c in ("source", "file_size_bytes", "doc_id", "filename", "content_hash") if c != key]
    new = incoming.select(key, "object_key", *[c for c in extra if c in incoming.columns])
    new = new.select(key, *[F.col(c).alias(f"new_{c}") for c in new.columns if c != key], F.lit(True).alias("is_new"))
    joined = existing.withColumn("is_old", F.lit(True)).join(new, key, "full_outer")
    picks = []
    for c in existing.columns:
        if c == "object_key":
            picks.append(F.coalesce("new_object_key", "object_key").alias(c))
        elif c == "embedding_status":
            picks.append(
                F.when(F.col("is_old").isNull(), "pending")
                .when(F.col("is_new"), _reopen(F.col(c)))
                .otherwise(F.col(c))
                .alias(c)
            )
        elif f"new_{c}" in new.columns:
            picks.append(F.when(F.col("is_old").isNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            picks.append(F.col(c))
    return joined.select(*picks)


def _settled(existing: DataFrame, incoming: DataFrame, key: str, other: str) -> DataFrame:
    """``incoming`` under the keys of the stored rows that it meets, one row per key."""
    stored = existing.select(key).distinct()
    own = incoming.join(stored, key, "left_semi").withColumn("own", F.lit(True))
    # One row per value of the other key on either side before they meet: copies do not multiply.
    rest = incoming.join(stored, key, "left_anti")
    values = [c for c in incoming.columns if c not in (key, "object_key", other)]
    one = rest.where(F.col(other).isNotNull()).groupBy(other).agg(
        F.min(key).alias(key), F.max_by("object_key", key).alias("object_key"), *[F.min_by(c, key).alias(c) for c in values]
    )
    met = existing.where(F.col(other).isNotNull()).groupBy(other).agg(F.min(key).alias("met"))
    moved = one.join(met, other, "left").withColumn(key, F.coalesce("met", key)).drop("met")
    rows = moved.unionByName(rest.where(F.col(other).isNull())).withColumn("own", F.lit(False)).unionByName(own)
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in incoming.columns if c != key]), F.struct("own", "object_key")).alias("r"))
    return kept.select(key, "r.*").select(*incoming.columns)


def basename(key: Column) -> Column:
    """Last path segment of a storage key."""
    return F.element_at(F.split(key, "/"), -1)


def missing_files(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """Listed objects whose file name is not registered."""
    files = listing.withColumn("filename", basename(F.col("key")))
    return files.join(docs.select("filename"), "filename", "left_anti")


def sync_outcomes(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per listed key: ``updated``, ``already_set`` or ``not_found``."""
    files = listing.select("key", basename(F.col("key")).alias("filename")).where("filename <> ''")
    known = docs.select("filename", "object_key", F.lit(True).alias("found"))
    stale = F.col("found") & (F.col("object_key").isNull() | (F.col("object_key") != F.col("key")))
    return (
        files.join(known, "filename", "left")
        .groupBy("key", "filename")
        .agg(F.max(stale).alias("stale"), F.max("found").alias("found"))
        .select(
            "key",
            "filename",
            F.when(F.col("stale"), "updated").when(F.col("found"), "already_set").otherwise("not_found").alias("outcome"),
        )
    )


def sync_keys(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts of the three outcomes and of processed keys, in one row."""
    outcome = sync_outcomes(listing, docs)
    return outcome.agg(
        F.count("*").alias("processed"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("updated", "already_set", "not_found")],
    )


def apply_sync_keys(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents with keys taken from the listing; failed rows are reopened."""
    latest = listing.select("key", basename(F.col("key")).alias("filename")).groupBy("filename").agg(F.max("key").alias("key"))
    change = F.col("key").isNotNull() & (F.col("object_key").isNull() | (F.col("object_key") != F.col("key")))
    return (
        docs.join(latest, "filename", "left")
        .withColumn("embedding_status", F.when(change, _reopen(F.col("embedding_status"))).otherwise(F.col("embedding_status")))
        .withColumn("object_key", F.when(change, F.col("key")).otherwise(F.col("object_key")))
        .select(*docs.columns)
    )


def verify_sync(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """Every distinct key of either side with its state: matched, missing or orphaned."""
    stored = listing.select("key").distinct().withColumn("in_store", F.lit(True))
    wanted = docs.where("object_key <> ''").select(F.col("object_key").alias("key")).distinct().withColumn("in_docs", F.lit(True))
    state = F.when(F.col("in_store") & F.col("in_docs"), "matched").when(F.col("in_docs"), "missing").otherwise("orphaned")
    head = F.when(F.contains("key", F.lit("/")), F.substring_index("key", "/", 1)).otherwise("unknown")
    return stored.join(wanted, "key", "full_outer").select("key", head.alias("source"), state.alias("state"))


def verify_sync_counts(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """Per source: keys in documents, in the store, matched, missing, orphaned."""
    is_state = {s: F.col("state") == s for s in ("matched", "missing", "orphaned")}
    return (
        verify_sync(listing, docs)
        .groupBy("source")
        .agg(
            F.count_if(~is_state["orphaned"]).alias("in_documents"),
            F.count_if(~is_state["missing"]).alias("in_store"),
            *[F.count_if(p).alias(s) for s, p in is_state.items()],
        )
    )


def clear_invalid_keys(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose key is absent from the store lose it."""
    stored = listing.select(F.col("key").alias("object_key")).distinct().withColumn("present", F.lit(True))
    return (
        docs.join(stored, "object_key", "left")
        .withColumn("object_key", F.when(F.col("present"), F.col("object_key")))
        .select(*docs.columns)
    )


def cross_source_duplicates(docs: DataFrame) -> DataFrame:
    """Hashes that occur in more than one source."""
    per_source = docs.groupBy("content_hash", "source").agg(F.count("*").alias("copies"))
    return (
        per_source.groupBy("content_hash")
        .agg(
            F.array_sort(F.collect_list("source")).alias("sources"),
            F.count("*").alias("source_count"),
            F.sum("copies").alias("copies"),
        )
        .where("source_count > 1")
    )
