"""Evidence notes, source ratings and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import strip
from corpusgraph.operators.search import like_pattern
from corpusgraph.session import cut_lineage, fits_broadcast


def verification_status() -> Column:
    """Seven-way verdict from tier, corroboration count and primary verification."""
    verified = F.coalesce("primary_doc_verified", F.lit(False))
    tier, n = F.col("source_credibility_tier"), F.col("corroboration_count")
    return (
        F.when(verified & (n >= 3), "VERIFIED - High Confidence")
        .when(verified & (n >= 1), "SUPPORTED - Primary Evidence")
        .when(tier <= 2, "CREDIBLE SOURCE - Needs Corroboration")
        .when((tier == 3) & (n >= 2), "PROBABLE - Multiple Sources")
        .when(tier == 3, "UNVERIFIED - Single Source")
        .when(tier >= 4, "QUESTIONABLE - Low Quality Source")
        .otherwise("UNKNOWN")
    )


def verification_scores(notes: DataFrame) -> DataFrame:
    """Notes with their verdict, supporting-document count and display order.

    ``display_order`` is 1 for verified with three or more corroborations, 2
    for any other verified note, 5 for the rest; an empty list counts as null.
    """
    verified = F.coalesce("primary_doc_verified", F.lit(False))
    size = F.size("corroborating_docs")
    return notes.select(
        "id", "subject",
        verification_status().alias("verification_status"),
        F.when(size > 0, size).alias("supporting_docs"),
        F.when(verified & (F.col("corroboration_count") >= 3), 1).when(verified, 2).otherwise(5).alias("display_order"),
    ).orderBy("display_order", "id")


def notes_by_category(notes: DataFrame, categories: list[str]) -> DataFrame:
    """Notes of the given allegation types, newest first."""
    return notes.where(F.col("allegation_type").isin(categories)).orderBy(F.desc("created_at"), "id")


def subjects(notes: DataFrame) -> DataFrame:
    """Subjects with their note count and latest note."""
    return notes.groupBy("subject").agg(F.count("*").alias("notes"), F.max("created_at").alias("latest")).orderBy(F.desc("notes"), "subject")


def notes_about(notes: DataFrame, subject: str) -> DataFrame:
    """Notes whose subject contains the name, newest first."""
    return notes.where(F.col("subject").ilike(f"%{like_pattern(subject)}%")).orderBy(F.desc("created_at"), "id")


def entity_notes(notes: DataFrame, entity_id) -> DataFrame:
    """Notes of one entity, newest first."""
    return notes.where(F.col("entity_id") == entity_id).orderBy(F.desc("created_at"), "id")


def subject_tags(tags: DataFrame, docs: DataFrame, subject: str) -> DataFrame:
    """Tags naming the subject with their document, if it is registered."""
    named = tags.where(F.col("accused_name").ilike(f"%{like_pattern(subject)}%"))
    return named.join(docs.select(F.col("doc_id").alias("document_id"), "filename", "source"), "document_id", "left")


def source_rating(ratings: DataFrame, domain: str) -> DataFrame:
    """One row with the first rating whose domain contains ``domain``, else ``NOT_RATED``."""
    hits = ratings.where(F.col("source_domain").ilike(f"%{like_pattern(domain)}%"))
    best = hits.agg(F.min_by(F.struct("source_domain", "source_name", "credibility_tier"), "source_domain").alias("r"))
    return best.select(
        F.lit(domain).alias("requested"), "r.*", F.when(F.col("r").isNull(), "NOT_RATED").otherwise("RATED").alias("status")
    )


def source_ratings(requested: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings for many requested domains at once.

    A requested domain takes the rating of itself or of a host below it; both
    meet by equi-join on the parent domains of the rated hosts.
    """
    parts = F.split(F.lower("source_domain"), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    rated = ratings.select(F.explode(parents).alias("key"), F.struct("source_domain", "source_name", "credibility_tier").alias("r"))
    # The first host per parent is all that is used, so hot parents shrink before the join.
    first = rated.groupBy("key").agg(F.min_by(F.col("r"), F.col("r.source_domain")).alias("r"))
    asked = requested.select("source_domain").distinct().withColumn("key", F.lower("source_domain"))
    return asked.join(first, "key", "left").select(
        F.col("source_domain").alias("requested"), "r.*", F.when(F.col("r").isNull(), "NOT_RATED").otherwise("RATED").alias("status")
    )


def sources_by_tier(ratings: DataFrame, tier: int | None = None) -> DataFrame:
    """Rated sources by tier and name."""
    rows = ratings.where(F.col("credibility_tier") == tier) if tier is not None else ratings
    return rows.orderBy("credibility_tier", "source_name", "source_domain")


def upsert_keep_old(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Upsert in which a null in the incoming row keeps the stored value.

    ``incoming`` is unique on ``key``; columns it lacks stay as they are.  Used
    for source ratings and for partial updates of verification fields.
    """
    fresh = incoming.select(key, *[F.col(c).alias(f"_new_{c}") for c in incoming.columns if c != key])
    cols = [
        F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in fresh.columns else F.col(c) for c in existing.columns
    ]
    return existing.join(fresh, key, "full_outer").select(*cols)


def finding_hash() -> Column:
    """md5 of the trimmed lower-case title and the sorted entities."""
    return F.md5(F.concat_ws("|", F.lower(strip(F.col("title"))), F.array_join(F.array_sort("entities"), "|")))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """Findings with ``content_hash`` and whether each one is the first of its kind.

    Uniqueness is per investigation; the earliest (created_at, id) wins.  The
    winner comes from a partial aggregate, not from ordering the group.
    """
    keyed = findings.withColumn("content_hash", finding_hash())
    order = F.struct("created_at", "id")
    first = keyed.groupBy("investigation_id", "content_hash").agg(F.min(order).alias("first"))
    return (
        keyed.join(first, ["investigation_id", "content_hash"])
        .withColumn("inserted", (F.col("first.created_at") == F.col("created_at")) & (F.col("first.id") == F.col("id")))
        .drop("first")
    )


def stored_findings(findings: DataFrame) -> DataFrame:
    """The kept findings, most confident first, then oldest."""
    return dedup_findings(findings).where("inserted").orderBy(F.desc("confidence"), "created_at", "id")


def band(confidence: Column) -> Column:
    """HIGH from .8, MEDIUM from .5, else LOW."""
    return F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.5, "MEDIUM").otherwise("LOW")


def confidence_bands(findings: DataFrame) -> DataFrame:
    """Findings per investigation and confidence band."""
    return findings.groupBy("investigation_id", band(F.col("confidence")).alias("band")).agg(
        F.count("*").alias("findings"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


def report_rows(findings: DataFrame, evidence: int = 5, entities: int = 15) -> DataFrame:
    """Findings with their band, first evidence items and first entities."""
    return findings.select(
        "id", "title", band(F.col("confidence")).alias("band"),
        F.slice("evidence", 1, evidence).alias("evidence"), F.slice("entities", 1, entities).alias("entities"),
    )


def platform_stats(docs: DataFrame, nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Documents, entities per label and vectors in one row of scalar aggregates."""
    labels = nodes.agg(
        *[F.count_if(F.col("label") == x).alias(x.lower()) for x in ("Person", "Organization", "Location", "Document")]
    )
    vectors = points.agg(F.count("*").alias("n"))
    return docs.agg(
        F.count("*").alias("documents"), F.count("text").alias("with_text"), F.countDistinct("source").alias("sources")
    ).select(
        "*",
        *[labels.select(c).scalar().alias(f"{c}_nodes") for c in labels.columns],
        vectors.scalar().alias("vectors"),
    )


def exact_quantiles(rows: DataFrame, value: str, shares: list[float], most: int = 100_000, accuracy: int = 1000) -> list[float | None]:
    """Interpolated quantiles of a double column, exact, without all values in one task; None without values.

    A mergeable sketch bounds where a rank lies, to within a few thousandths of
    the rows; these are counted and bounded again until they hold at most
    ``most`` different values, whose counts decide.
    """
    base = rows.select(F.col(value).alias("v")).where(F.col(value).isNotNull())
    n = base.count()
    return [_quantile(base, n, share, most, accuracy) if n else None for share in shares]


def _quantile(frame: DataFrame, n: int, share: float, most: int, accuracy: int) -> float:
    place = (n - 1) * share
    low = int(place)
    high = min(low + 1, n - 1)
    below, size = 0, n
    while not fits_broadcast(frame.select("v").distinct(), most):
        near = [max(0.0, (low - below) / size - 2 / accuracy), min(1.0, (high + 1 - below) / size + 2 / accuracy)]
        a, b = frame.agg(F.percentile_approx("v", F.array(*map(F.lit, near)), accuracy).alias("q")).first().q
        got = frame.agg(F.count_if(F.col("v") < a).alias("under"), F.count_if(F.col("v").between(a, b)).alias("inside")).first()
        if not (below + got.under <= low and high < below + got.under + got.inside):
            raise RuntimeError("the sketch missed its bound: raise ``accuracy``")
        if got.inside == size:
            raise RuntimeError(f"over {most} values lie within the sketch's bound: raise ``accuracy`` or ``most``")
        frame, below, size = frame.where(F.col("v").between(a, b)), below + got.under, got.inside
    ends = {}
    for r in frame.groupBy("v").count().orderBy("v").collect():
        for rank in (low, high):
            if below <= rank < below + r["count"]:
                ends[rank] = r.v
        below += r["count"]
    return ends[low] if low == high else (high - place) * ends[low] + (place - low) * ends[high]


def outliers(rows: DataFrame, key: str, value: str, z: float = 3.0, fence: float = 1.5) -> DataFrame:
    """Rows outside z standard deviations or the interquartile fences.

    ``rows`` is read once; what follows reads its keys and values from a
    checkpoint.
    """
    kept = cut_lineage(rows.select(key, F.col(value).alias(value), F.col(value).cast("double").alias("_v")))
    stats = kept.agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd")).first()
    q1, q3 = exact_quantiles(kept, "_v", [0.25, 0.75])
    v, mean, sd, q1, q3 = F.col("_v"), *(F.lit(x).cast("double") for x in (stats.mean, stats.sd, q1, q3))
    margin = fence * (q3 - q1)
    score = F.round((v - mean) / F.nullif(sd, F.lit(0.0)), 6)
    out = kept.select(key, value, score.alias("z_score"), ((v < q1 - margin) | (v > q3 + margin)).alias("outside_iqr"))
    return out.where((F.abs("z_score") >= z) | F.col("outside_iqr"))


def entity_document_filter(docs: DataFrame, text: str = "", doc_type: str | None = None) -> DataFrame:
    """An entity's documents whose file name contains ``text``, of one type."""
    kept = docs.where(F.contains(F.lower("filename"), F.lit(text.lower()))) if text else docs
    return kept.where(F.col("doc_type") == doc_type) if doc_type else kept


def document_types(docs: DataFrame) -> DataFrame:
    """The distinct document types in order."""
    return docs.select("doc_type").where("doc_type IS NOT NULL").distinct().orderBy("doc_type")
