"""Cleaning, routing and shaping of document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reply phrases that mark a refused transcription.
REFUSAL_PHRASES = [
    "i can't assist",
    "i'm sorry",
    "i cannot",
    "i'm unable",
    "as an ai",
    "i apologize",
    "not able to help",
    "can't extract text from images",
]

# The allowed document categories, in match order.
CATEGORIES = [
    "email",
    "deposition_transcript",
    "court_filing",
    "financial_record",
    "flight_log",
    "calendar_entry",
    "letter_correspondence",
    "legal_motion",
    "fbi_report",
    "photograph",
    "handwritten_note",
    "other",
]

# File extensions behind each document type.
DOCUMENT_EXTS = ["pdf"]
IMAGE_EXTS = ["jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff"]
VIDEO_EXTS = ["mp4", "mov", "m4v", "3gp"]
AUDIO_EXTS = ["m4a", "opus", "wav", "mp3"]
PHONE_AUDIO_EXTS = ["amr"]


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_hash(body: Column) -> Column:
    """MD5 of bytes or text, the identity used for exact deduplication."""
    return F.md5(body)


def clean_text(text: Column, cap: int | None = None) -> Column:
    """Drop NUL and BOM, replace non-ASCII by ``?``; the first ``cap`` characters if given."""
    bare = F.regexp_replace(text, "[\\x00\\uFEFF]", "")
    plain = F.regexp_replace(bare, r"[^\x00-\x7F]", "?")
    return plain if cap is None else F.substring(plain, 1, cap)


def doc_type_of(ext: Column, coarse: bool = False) -> Column:
    """Document type from an extension; ``coarse`` is the four-way local mapping."""
    e = F.lower(F.regexp_replace(ext, r"^\.", ""))
    if coarse:
        return (
            F.when(e.isin(IMAGE_EXTS), "Image")
            .when(e == "pdf", "PDF")
            .when(e.isin(VIDEO_EXTS + AUDIO_EXTS), "Media")
            .otherwise("Document")
        )
    return (
        F.when(e.isin(DOCUMENT_EXTS), "Court Filing")
        .when(e.isin(IMAGE_EXTS), "Image")
        .when(e.isin(VIDEO_EXTS), "Video")
        .when(e.isin(AUDIO_EXTS + PHONE_AUDIO_EXTS), "Audio")
        .otherwise("Document")
    )


def source_slug(name: Column, width: int | None = None) -> Column:
    """Blanks to hyphens, commas and dots dropped, lower case; the first ``width`` characters if given."""
    kept = F.substring(name, 1, width) if width else name
    return F.lower(F.translate(kept, " ,.", "-"))


def object_key(source: Column, digest: Column, filename: Column) -> Column:
    """Storage key ``source/first four of the hash/filename``."""
    return F.concat_ws("/", source, F.substring(digest, 1, 4), filename)


def route_extraction(text: Column, minimum: int = 50) -> Column:
    """``error`` without text, ``needs_ocr`` when too short, else ``completed``."""
    return (
        F.when(text.isNull(), "error")
        .when(F.length(strip(text)) < minimum, "needs_ocr")
        .otherwise("completed")
    )


def preview(text: Column, n: int) -> Column:
    """First ``n`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def effective_text(text: Column, extracted: Column, display_cap: int | None = None) -> Column:
    """The primary text, else the extracted one; blanks count as missing.  Whole unless a cap is given."""
    body = F.coalesce(F.nullif(text, F.lit("")), F.nullif(extracted, F.lit("")))
    return body if display_cap is None else F.substring(body, 1, display_cap)


def is_refusal(text: Column) -> Column:
    """Whether any refusal phrase occurs, ignoring case."""
    low = F.lower(text)
    hit = F.lit(False)
    for phrase in REFUSAL_PHRASES:
        hit = hit | F.contains(low, F.lit(phrase))
    return hit


def choose_text(primary: Column, fallback: Column) -> Column:
    """Pick between two transcriptions and say which was used.

    A refused or short (< 50) primary gives way to a fallback longer than five
    characters; two-character and ``EMPTY`` answers become a placeholder.
    """
    usable = F.when(~is_refusal(primary) & (F.length(primary) >= 50), primary)
    second = F.when(F.length(strip(fallback)) > 5, fallback)
    chosen = F.coalesce(usable, second)
    blank = (F.upper(chosen) == "EMPTY") | (F.length(strip(chosen)) <= 2)
    return F.struct(
        F.when(blank, "[no visible text]").otherwise(chosen).alias("text"),
        F.when(usable.isNotNull(), "primary").when(second.isNotNull(), "fallback").otherwise("error").alias("method"),
        F.when(chosen.isNull(), "no_text_extracted").alias("error"),
    )


def normalize_label(raw: Column, allowed: list[str] | None = None) -> Column:
    """Map free text onto a fixed category: exact, then first contained, else ``other``."""
    names = allowed or CATEGORIES
    label = F.regexp_replace(F.translate(F.lower(strip(raw)), " ", "_"), "^[.,;:!?\"'`]+|[.,;:!?\"'`]+$", "")
    result = F.when(label.isin(names), label)
    for name in names:
        result = result.when(F.contains(label, F.lit(name)), F.lit(name))
    return result.otherwise("other")


def match_count(text: Column, term: str) -> Column:
    """Literal, case-insensitive, non-overlapping occurrences of ``term``."""
    low = F.lower(text)
    cut = F.replace(low, F.lit(term.lower()), F.lit(""))
    return ((F.length(low) - F.length(cut)) / len(term)).cast("bigint")


def text_stats(text: Column, store_cap: int | None = None, index_cap: int | None = None) -> Column:
    """Stored text, its true length, and the text for the search index; whole unless caps are given."""
    part = lambda cap: text if cap is None else F.substring(text, 1, cap)
    return F.struct(
        part(store_cap).alias("stored_text"),
        F.length(text).cast("bigint").alias("text_length"),
        part(index_cap).alias("index_text"),
    )


def mentions_year(text: Column, first: int, last: int) -> Column:
    """Whether any year of the inclusive range is written in the text."""
    return text.rlike("|".join(str(y) for y in range(first, last + 1)))


def merge_metadata(base: Column, patch: Column) -> Column:
    """Shallow merge of two string maps; keys of ``patch`` win."""
    keys = F.map_keys(patch)
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(keys, k))
    return F.when(base.isNull(), patch).when(patch.isNull(), base).otherwise(F.map_concat(kept, patch))


def drop_keys(base: Column, *names: str) -> Column:
    """The map without the named keys."""
    return F.map_filter(base, lambda k, _: ~k.isin(list(names)))
