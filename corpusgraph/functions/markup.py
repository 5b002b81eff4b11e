"""HTML escaping and tag removal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_html(text: Column) -> Column:
    """Escape the four characters that matter inside element text."""
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def strip_tags(html: Column) -> Column:
    """Remove every tag, keep the text."""
    return F.regexp_replace(html, r"<[^>]*>", "")


def keep_tags(html: Column, allowed: tuple[str, ...] = ("mark",)) -> Column:
    """Remove every tag except the allowed ones, whose attributes are dropped."""
    names = "|".join(allowed)
    others = F.regexp_replace(html, rf"(?i)<(?!/?(?:{names})(?:\s[^>]*)?>)[^>]*>", "")
    return F.regexp_replace(others, rf"(?i)<(/?)({names})(?:\s[^>]*)?>", "<$1$2>")
