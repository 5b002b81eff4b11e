"""Secret scan: fixed patterns plus sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 6

#: Runs that may hold a secret: at least one window long.
WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Least bits per character of the best window, by character class. A window of
#: 20 holds 4.32 at most; ordinary words and identifiers stay below these.
LEAST_BITS = {"hex": 3.0, "upper": 3.4, "alnum": 3.5, "base64": 3.7}
#: Candidates that are no secrets: words without a digit, numbers, uuids,
#: placeholders, paths of plain words, and names joined by - or _.
ALLOW = (
    r"[A-Za-z+/_=-]+",
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i:.*(example|placeholder|changeme|your[-_]?(key|token|secret)|x{6,}|dummy|sample).*)",
    r"[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*",
)


def char_class(run: str) -> str:
    """The narrowest class that holds all characters of ``run``."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    if re.fullmatch(r"[A-Z0-9]+", run):
        return "upper"
    return "alnum" if re.fullmatch(r"[a-z0-9_-]+", run) else "base64"


def best_entropy(run: str, width: int = WINDOW) -> float:
    """Largest Shannon entropy of any window, from counts changed one character at a time.

    With counts c, H = log2(w) - sum(c log2 c) / w, so a slide changes two terms.
    """
    width = min(width, len(run))
    if not width:
        return 0.0
    term = [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    counts: dict[str, int] = {}
    total, least = 0.0, math.inf
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n] if n < width else 0.0
        if i >= width - 1:
            least = min(least, total)
            gone = run[i - width + 1]
            n = counts[gone]
            counts[gone] = n - 1
            total += term[n - 1] - term[n]
    return max(0.0, math.log2(width) - least / width)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, base: list[tuple[int, int, int]], allow: re.Pattern) -> list[tuple[int, int, int]]:
    """Candidates whose best window is random enough, unless allowed or inside a base span."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if allow.fullmatch(run) or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if best_entropy(run) >= LEAST_BITS[char_class(run)]:
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with ``secret_spans`` (array of kind, start, end; by start, then kind) over the whole text.

    Positions count code points, end exclusive. A null or empty text has no
    spans. Every row, repeated ones too, is scanned by itself, so no key can be
    hot; other columns pass through, but for one named ``secret_spans``, which
    is replaced.
    """
    schema = "array<struct<kind:string,start:long,end:long>>"

    @F.pandas_udf(schema)
    def spans(texts: pd.Series) -> pd.Series:
        allowed = re.compile("|".join(f"(?:{a})" for a in allow)) if allow else re.compile(r"(?!)")
        out = []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + entropy_spans(t, base, allowed))])
        return pd.Series(out)

    return docs.withColumn("secret_spans", spans(F.col(text)))


def secret_digest(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans as one string."""
    found = scan_secrets(docs.select("doc_id", "text"), "text", allow).drop("text")
    one = lambda x: F.concat_ws(":", x.kind, x.start, x.end)
    base = F.filter("secret_spans", lambda x: x.kind != "entropy")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x.kind == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secret_spans", one), ",").alias("spans"),
        count("entropy").alias("n_entropy"),
    )
