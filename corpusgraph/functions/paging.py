"""Coercion of paging and query arguments, done while the plan is built."""

from __future__ import annotations

import math


def _number(value) -> float:
    if value is None:
        return math.nan
    try:
        return float(value)
    except (TypeError, ValueError):
        return math.nan


def coerce_page(page=None, limit=None) -> tuple[int, int]:
    """(page, limit) as positive integers; limit defaults to 25 and never exceeds 100."""
    p, n = _number(page), _number(limit)
    page_out = 1 if math.isnan(p) or p < 1 else int(p)
    if math.isnan(n):
        return page_out, 25
    return page_out, 1 if n < 1 else min(100, int(n))


def coerce_query(query: str) -> str:
    """Trimmed, non-empty, at most 500 characters."""
    text = query.strip()
    if not text:
        raise ValueError("the search query is empty")
    return text[:500]
