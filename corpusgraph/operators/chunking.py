"""Overlapping chunks that end on a sentence or a word.

The whole scan is one JVM-side fold over the text: in each step a greedy
regular expression finds the last usable break in the tail of the window.
Short documents never enter the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.binding import let
from corpusgraph.functions.ids import chunk_point_id
from corpusgraph.functions.text import preview, strip

CHUNK = "struct<chunk_index:int,start_char:int,end_char:int,text:string>"


def chunk_column(text: Column, size: int = 6000, overlap: int = 500, most: int | None = None, strict: bool = False) -> Column:
    """Array of chunks of one text.

    ``strict`` keeps the extra tail chunk that already lies inside the previous
    one; by default the scan ends once a chunk reaches the end of the text.
    ``most`` limits the chunks per text; without it the whole text is cut.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    tail = min(500, size)
    # The least a window can move forward, which bounds the number of rounds.
    advance = size - tail + 1 - overlap if size - tail + 1 > overlap else size - tail + 1

    def step(state: Column, text: Column, n: Column) -> Column:
        start = state["start"]
        full = start + size
        zone = full - tail  # first character of the break zone, 0-based
        breaks = F.struct(
            F.length(F.regexp_extract(text.substr(zone + 1, F.lit(tail + 1)), r"(?s)^(.*[.!?\n])[ \n\t]", 1)).alias("sentence"),
            F.length(F.regexp_extract(text.substr(zone + 1, F.lit(tail)), r"(?s)^(.*[ \n\t])", 1)).alias("word"),
        )

        def window(found: Column) -> Column:
            # ``reach`` is the end before it is clamped to the text.
            return (
                F.when(full >= n, full)
                .when(found["sentence"] > 0, zone + found["sentence"])
                .when(found["word"] > 0, zone + found["word"])
                .otherwise(full)
            )

        def close(reach: Column) -> Column:
            return let(strip(text.substr(start + 1, F.least(reach, n) - start)), lambda body: advance_to(reach, body))

        def advance_to(reach: Column, body: Column) -> Column:
            piece = F.struct(
                F.size(state["chunks"]).alias("chunk_index"), start.alias("start_char"),
                F.least(reach, n).cast("int").alias("end_char"), body.alias("text"),
            )
            last = F.when(body != "", start).otherwise(state["last"])
            back = reach - overlap
            following = F.when((last >= 0) & (back <= last), reach).otherwise(back)
            after = following if strict else F.when(reach >= n, n).otherwise(following)
            grown = F.when(body != "", F.concat(state["chunks"], F.array(piece))).otherwise(state["chunks"])
            return F.struct(after.cast("int").alias("start"), last.cast("int").alias("last"), grown.alias("chunks"))

        live = start < n
        if most is not None:
            live = live & (F.size(state["chunks"]) < most)
        return F.when(live, let(breaks, lambda found: let(window(found), close))).otherwise(state)

    empty = F.struct(
        F.lit(0).alias("start"), F.lit(-1).alias("last"), F.array().cast(f"array<{CHUNK}>").alias("chunks")
    )

    def fold(doc: Column) -> Column:
        rounds = F.sequence(F.lit(1), (F.lit(1) + F.ceil(doc["n"] / advance)).cast("int"))
        return F.aggregate(rounds, empty, lambda s, _: step(s, doc["text"], doc["n"]), lambda s: s["chunks"])

    n = F.length(text)
    folded = let(F.struct(text.alias("text"), n.alias("n")), fold)
    whole = F.array(
        F.struct(
            F.lit(0).alias("chunk_index"), F.lit(0).alias("start_char"), F.coalesce(n, F.lit(0)).alias("end_char"), text.alias("text")
        )
    )
    return F.when(text.isNull() | (n <= size), whole.cast(f"array<{CHUNK}>")).otherwise(folded)


def chunk_text(docs: DataFrame, column: str = "text", **opt) -> DataFrame:
    """One row per chunk with its index, span and the document's chunk count."""
    keep = [c for c in docs.columns if c != column]
    cut = docs.withColumn("_chunks", chunk_column(F.col(column), **opt))
    return cut.select(*keep, F.size("_chunks").alias("total_chunks"), F.inline("_chunks"))


def assign_point_ids(chunks: DataFrame) -> DataFrame:
    """Add the deterministic point id and the 200-character preview of each chunk."""
    return chunks.withColumn("point_id", chunk_point_id(F.col("doc_id"), F.col("chunk_index"))).withColumn(
        "text_preview", preview(F.col("text"), 200)
    )
