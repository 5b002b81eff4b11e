"""Benchmark decontamination by pigeonhole edit matching.

A test item within k edits of a stretch of text leaves one of any k + 1 pieces
of the item untouched, so the piece occurs there exactly. Exact piece hits come
from one automaton over all items; Myers' bit-parallel algorithm then gives the
least edit distance of the item to any stretch around the hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import rows_of, stored
from corpusgraph.session import broadcast_if_small

#: Edits allowed per character of a normalised item.
RATE = 0.08
#: Items shorter than this match exactly or not at all; shorter than the second, at word boundaries only.
SHORT = 40
LEAST = 20
#: Most characters of items that one automaton holds; more items take more passes.
BLOCK_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate) if length >= SHORT else 0


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` adjacent pieces of near-equal length, with their offsets."""
    cuts = [i * len(item) // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern: str, peq: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and the end of the first such stretch.

    Columns of the alignment matrix are bit vectors of vertical differences;
    the text may start anywhere, so the top row stays 0.
    """
    m = len(pattern)
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word of ``text`` goes on over either end of the stretch."""
    word = lambda a: 0 < a < len(text) and (text[a - 1].isalnum() or text[a - 1] == "_") and (text[a].isalnum() or text[a] == "_")
    return not word(start) and not word(end)


class Matcher:
    """All items of a block: finds each item's best match in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        self.seen = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalised(text)
            if not text:
                continue
            at, k = len(self.items), budget(len(text), rate)
            self.items.append((item_id, text, k, masks(text)))
            for offset, piece in pieces(text, k):
                places.setdefault(piece, []).append((at, offset))
        for piece, where in places.items():
            self.seen.add_word(piece, (len(piece), where))
        if places:
            self.seen.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item_id, distance, end)`` of every item within its budget; end counts normalised characters."""
        if not self.items:
            return []
        text = normalised(text)
        tried: dict[int, tuple[int, int]] = {}
        best: dict[int, tuple[int, int]] = {}
        for last, (size, where) in self.seen.iter(text):
            for at, offset in where:
                item_id, item, k, peq = self.items[at]
                start = last + 1 - size - offset  # where the item would begin without edits
                low, high = max(0, start - k), min(len(text), start + len(item) + k)
                # Other pieces of the same occurrence hit too; their stretch was read already.
                before = tried.get(at)
                if before and before[0] <= low and high <= before[1]:
                    continue
                got = best.get(at)
                if got and got[0] == 0:
                    continue
                if len(item) < LEAST:
                    if whole_words(text, start, start + len(item)):
                        best[at] = (0, start + len(item))
                    continue
                low, high = max(0, low - k), min(len(text), high + k)
                tried[at] = (low, high)
                distance, end = myers(item, peq, text[low:high])
                if distance <= k and (got is None or distance < got[0]):
                    best[at] = (distance, low + end)
        return [(self.items[at][0], d, e) for at, (d, e) in sorted(best.items())]


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded size, each collected by itself."""
    usable = stored(items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    at = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    for b in range(blocks if total else 0):
        yield [(r.item_id, r.text) for r in usable.filter(at == b).collect()]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, end_at``: each document and each item found in it within the item's edit budget.

    Matching ignores case and the kind of white space and reads whole texts;
    ``end_at`` is the match's end in the text so normalised. Items under
    ``LEAST`` normalised characters match exactly and as whole words; null and
    empty ones match nothing, null or empty documents hold none. Every item is sought in every document: items
    are a stated query set, taken in blocks of at most about ``block_chars``
    characters, one pass each, whose hits are stored before the next. Copies of an item id are matched as one item
    each; repeated documents give repeated rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, end_at long"
    found = None
    for block in item_blocks(items, block_chars):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, rate)
            for whole in batches:
                for batch in rows_of(whole):
                    out = [
                        (doc, *hit)
                        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                        for hit in matcher.matches(text)
                    ]
                    if out:
                        doc, item, distance, end = zip(*out)
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(doc, pa.int64()), "item_id": pa.array(item, pa.int64()),
                            "distance": pa.array(distance, pa.int32()), "end_at": pa.array(end, pa.int64()),
                        })

        part = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "hits")
        held.destroy()
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents that hold an item; columns as given. Rows without doc_id stay."""
    hit = stored(contaminated(docs, items, rate).select("doc_id").distinct(), "contaminated")
    return docs.join(broadcast_if_small(hit), "doc_id", "left_anti")
