"""Entities, findings and views drawn out of text and model answers."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.binding import let
from corpusgraph.functions.names import title_case
from corpusgraph.functions.text import strip
from corpusgraph.operators.search import tokenize
from corpusgraph.session import cut_lineage

#: Names that one automaton holds, some hundred megabytes at most.
NAME_BLOCK = 200_000

KINDS = ("people", "organizations", "locations")

# The accepted finding types.
FINDING_TYPES = [
    "connection",
    "pattern",
    "anomaly",
    "document",
    "entity",
    "timeline_event",
    "contradiction",
    "corroboration",
    "claim",
    "evidence_gap",
]


def first_object(text: Column) -> Column:
    """The text from the first brace to the one that closes it, null without one.

    A fold over the marks that matter counts the depth; braces and escaped
    quotes inside strings do not count.
    """
    marks = F.regexp_extract_all(F.substring(text, F.instr(text, "{"), F.length(text)), F.lit(r'(?s)\\.|["{}]|[^\\"{}]+|\\'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(s: Column, mark: Column) -> Column:
        up = F.when(~s["inside"] & (mark == "{"), 1).when(~s["inside"] & (mark == "}"), -1).otherwise(0)
        depth = s["depth"] + up
        closed = (s["end"] == 0) & (up == -1) & (depth == 0)
        return F.struct(
            depth.alias("depth"), F.when(mark == '"', ~s["inside"]).otherwise(s["inside"]).alias("inside"),
            (s["seen"] + 1).alias("seen"), F.when(closed, s["seen"] + 1).otherwise(s["end"]).alias("end"),
        )

    def cut(found: Column) -> Column:
        return let(F.aggregate(found, start, step)["end"], lambda end: F.when(end > 0, F.array_join(F.slice(found, F.lit(1), end), "")))

    return F.when(F.instr(text, "{") > 0, let(marks, cut))


def parse_entity_json(raw: Column) -> Column:
    """Struct of three string arrays from a model answer.

    The object that the answer is, or the first one in surrounding prose, of
    any depth; else the bracketed array after each key.  Members that are not
    strings are dropped; an answer with nothing usable gives null.
    """
    def strings(doc: Column, kind: str) -> Column:
        members = F.coalesce(
            F.try_variant_get(doc, f"$.{kind}", "array<variant>"), F.array().cast("array<variant>")
        )
        texts = F.filter(members, lambda v: F.schema_of_variant(v) == "STRING")
        return F.transform(texts, lambda v: F.try_variant_get(v, "$", "string"))

    def quoted(text: Column, kind: str) -> Column:
        inside = F.regexp_extract(text, rf'(?s)"{kind}"\s*:\s*\[(.*?)\]', 1)
        return F.transform(F.regexp_extract_all(inside, F.lit('"([^"]+)"'), 1), strip)

    def loose(text: Column) -> Column:
        found = F.struct(*[quoted(text, k).alias(k) for k in KINDS])
        return let(found, lambda f: F.when(F.size(F.concat(*[f[k] for k in KINDS])) > 0, f))

    def read(text: Column, block: Column, doc: Column) -> Column:
        known = F.lit(False)
        for kind in KINDS:
            known = known | F.try_variant_get(doc, f"$.{kind}", "variant").isNotNull()
        # The parser stops after the first value, so trailing prose is ruled out here.
        parsed = doc.isNotNull() & ((strip(text) == block) | known)
        return F.when(parsed, F.struct(*[strings(doc, k).alias(k) for k in KINDS])).otherwise(loose(text))

    # Text, object and value are bound: each is costly and needed several times.
    return let(raw, lambda text: let(first_object(text), lambda block: let(F.try_parse_json(block), lambda doc: read(text, block, doc))))


def entity_lists(answers: DataFrame, key: str, raw: str) -> DataFrame:
    """``key`` and the three string arrays of every answer with something usable.

    A generator drops the others: a filter on the parsed value would parse
    twice, and before the rows are spread.
    """
    return answers.select(key, F.inline(F.array_compact(F.array(parse_entity_json(F.col(raw))))))


def gazetteer_entities(docs: DataFrame, names: DataFrame, block: int = NAME_BLOCK) -> DataFrame:
    """Known names (name, and kind if there is one) written in each document, Title-Cased.

    Persons, and names without a kind, need two words; other kinds one.

    Names are taken in blocks of about ``block``, by a hash.  The tasks build
    one automaton over a block and read every text once through it, whatever
    the names' number and lengths; a block is what is broadcast.
    """
    listed = (
        names.select(tokenize(F.col("name"), stop=False).alias("t"), (F.col("kind") if "kind" in names.columns else F.lit("Person")).alias("kind"))
        .where(F.size("t") >= F.when(F.col("kind") == "Person", 2).otherwise(1))
        .select(F.array_join("t", " ").alias("gram"))
        .distinct()
    )
    listed = cut_lineage(listed)
    blocks = max(1, -(-listed.count() // block))
    spaced = F.concat(F.lit(" "), F.array_join(tokenize(F.col("text"), stop=False), " "), F.lit(" "))
    texts = docs.select("doc_id", spaced.alias("spaced"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, gram string"
    found = None
    for number in range(blocks):
        mine = listed.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == number).toArrow()["gram"].to_pylist()
        held = docs.sparkSession.sparkContext.broadcast(mine)

        def read(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = automaton((f" {g} ", g) for g in held.value)
            for b in batches:
                at, grams = [], []
                for i, text in enumerate(b.column("spaced").to_pylist()):
                    if text and known:
                        hits = {g for _, g in known.iter(text)}
                        at += [i] * len(hits)
                        grams += hits
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(grams, pa.string())], names=["doc_id", "gram"])

        part = texts.mapInArrow(read, schema)
        found = part if found is None else found.unionByName(part)
    return found.select("doc_id", title_case(F.col("gram")).alias("name"))


def automaton(words: Iterable[tuple[str, object]]) -> ahocorasick.Automaton | None:
    """One that finds all given words in one pass over a text, each with its value; None without words."""
    known = ahocorasick.Automaton()
    for word, value in words:
        if word:
            known.add_word(word, value)
    known.make_automaton()
    return known if len(known) else None


def capitalized_runs(docs: DataFrame, min_words: int = 1, shortest: int = 3, longest: int = 99) -> DataFrame:
    """Mentions (doc_id, name, mention_count) of capitalised word runs, in any script with letter case."""
    word = r"(?<![\p{L}\p{N}_])\p{Lu}\p{Ll}+(?![\p{L}\p{N}_])"
    pattern = f"{word}(?: {word}){{{min_words - 1},}}"
    runs = F.regexp_extract_all(F.col("text"), F.lit(pattern), 0)
    return (
        docs.select("doc_id", F.explode(runs).alias("name"))
        .where(F.length("name").between(shortest, longest))
        .groupBy("doc_id", "name")
        .agg(F.count("*").alias("mention_count"))
    )


def find_spans(text: str, names: list[str]) -> list[dict]:
    """Whole-word occurrences of the names in one text, leftmost first, none overlapping."""
    low = text.lower()
    if len(low) != len(text):  # lower-casing moved positions; compare character by character
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    word = frozenset(string.ascii_letters + string.digits + "_")

    def edge(i: int) -> bool:
        return (i > 0 and text[i - 1] in word) != (i < len(text) and text[i] in word)

    orders: dict[str, list[int]] = {}
    for order, name in enumerate(names):
        orders.setdefault(name.lower(), []).append(order)
    known = automaton((wanted, (wanted, listed)) for wanted, listed in orders.items())
    hits, past = [], {}
    for last, (wanted, listed) in known.iter(low) if known else ():
        at = last + 1 - len(wanted)
        if at >= past.get(wanted, 0) and edge(at) and edge(last + 1):
            past[wanted] = last + 1
            hits += [(at, order, len(wanted), names[order]) for order in listed]
    kept, free = [], 0
    for start, _, length, name in sorted(hits):
        if start >= free:
            kept.append({"start_char": start, "length": length, "name": name})
            free = start + length
    return kept


def entity_spans(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Whole-word, case-insensitive, non-overlapping occurrences, leftmost first.

    Each document meets the list of its own names and is read once through an
    automaton over them.
    """
    @F.pandas_udf("array<struct<start_char:int,length:int,name:string>>")
    def spans(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([find_spans(text, listed) for text, listed in zip(texts, names)])

    listed = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    found = docs.select("doc_id", "text").join(listed, "doc_id").select("doc_id", spans("text", "names").alias("s"))
    return found.select("doc_id", F.inline("s"))


def parse_findings(analyses: DataFrame, title_width: int | None = None) -> DataFrame:
    """Findings from blank-line separated blocks of ``KEY: value`` lines.

    ``analyses`` has (analysis_id, analysis); a block without a title of at
    least five characters is skipped, the last value of a repeated key wins.
    """
    blocks = analyses.select("analysis_id", F.posexplode(F.split("analysis", "\n\n")).alias("block_no", "block"))
    lines = F.filter(F.split(strip(F.col("block")), "\n"), lambda x: F.contains(x, F.lit(":")))

    def value(key: str) -> Column:
        keyed = F.filter(lines, lambda x: F.upper(strip(F.substring_index(x, ":", 1))) == key)
        return strip(F.regexp_replace(F.try_element_at(keyed, F.lit(-1)), r"^[^:]*:", ""))

    lines_of = {k: value(k) for k in ("FINDING", "CONFIDENCE", "TYPE", "ENTITIES", "DESCRIPTION")}
    level = F.upper(F.coalesce(lines_of["CONFIDENCE"], F.lit("MEDIUM")))
    kind = F.translate(F.lower(F.coalesce(lines_of["TYPE"], F.lit("pattern"))), " ", "_")
    members = F.filter(
        F.transform(F.split(F.coalesce(lines_of["ENTITIES"], F.lit("")), ","), strip),
        lambda e: (e != "") & (F.upper(e) != "NONE"),
    )
    return (
        blocks.withColumn("title", lines_of["FINDING"])
        .where(F.length("title") >= 5)
        .select(
            "analysis_id",
            "block_no",
            (F.substring("title", 1, title_width) if title_width else F.col("title")).alias("title"),
            F.coalesce(lines_of["DESCRIPTION"], F.col("title")).alias("description"),
            F.when(level == "HIGH", 0.85).when(level == "MEDIUM", 0.7).otherwise(0.5).alias("confidence"),
            F.when(kind.isin(FINDING_TYPES), kind).otherwise("pattern").alias("finding_type"),
            members.alias("entities"),
        )
    )


def parse_findings_naive(analyses: DataFrame, confidence: float = 0.7, title_width: int | None = None) -> DataFrame:
    """Findings from bullets and numbers: each such line opens an item, the rest continue it.

    The items of a text are cut inside its row: a fold collects lines, so no
    group of lines is ever shuffled.
    """
    lines = F.transform(F.split("analysis", "\n"), strip)
    opens = lambda x: x.rlike(r"^(?:[0-9]|- |\* )")
    start = F.array().cast("array<array<string>>")

    def gather(items: Column, line: Column) -> Column:
        grown = F.concat(
            F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))),
            F.array(F.concat(F.element_at(items, -1), F.array(line))),
        )
        return F.when(opens(line), F.concat(items, F.array(F.array(line)))).when(F.size(items) > 0, grown).otherwise(items)

    items = analyses.select("analysis_id", F.posexplode(F.aggregate(lines, start, gather)).alias("item_no", "item"))
    text = strip(F.array_join("item", " "))
    head = F.element_at("item", 1)
    title = F.regexp_replace(F.substring(head, 1, title_width) if title_width else head, r"^[0-9.\-*) ]+", "")
    return items.where(F.length(text) >= 20).select(
        "analysis_id", "item_no", title.alias("title"), text.alias("description"), F.lit(confidence).alias("confidence")
    )


def embedding_views(docs: DataFrame, shortest: int = 20, cap: int | None = None) -> DataFrame:
    """One to three texts per analysed document: full text, people, context; the first ``cap`` characters if given.

    ``docs`` has (doc_id, text, document_type, people, locations, objects).
    """
    people = F.array_join("people", " | ")
    kind = F.col("document_type")
    context = F.concat_ws(
        ". ",
        F.when(kind != "", F.concat(F.lit("Document type: "), kind)),
        F.when(F.size("locations") > 0, F.concat(F.lit("Locations: "), F.array_join("locations", ", "))),
        F.when(F.size("objects") > 0, F.concat(F.lit("Objects: "), F.array_join("objects", ", "))),
    )
    views = F.array(
        *[
            F.struct(F.lit(name).alias("embedding_type"), F.lit(suffix).alias("suffix"), body.alias("body"))
            for name, suffix, body in [
                ("full_text", "text", F.col("text")),
                ("people", "people", people),
                ("context", "context", context),
            ]
        ]
    )
    kept = F.filter(views, lambda v: F.length(strip(v["body"])) >= shortest)
    rows = docs.select("doc_id", F.inline(kept))
    return rows.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), "suffix").alias("point_name"),
        "doc_id",
        "embedding_type",
        (F.substring("body", 1, cap) if cap else F.col("body")).alias("text"),
    )


def image_summary(images: DataFrame, smallest: int = 100, photo_pixels: int = 100_000, keep: int | None = None) -> DataFrame:
    """Per document: images of at least 100×100, pixels, photo flag, and the images in page order.

    With ``keep`` only the first ones are listed, and each task ranks no more
    than these; the sums come from a partial aggregate.
    """
    big = images.where((F.col("width") >= smallest) & (F.col("height") >= smallest))
    totals = big.groupBy("doc_id").agg(
        F.count("*").alias("image_count"), F.sum(F.col("width").cast("bigint") * F.col("height")).alias("total_pixels")
    )
    listed = big
    if keep is not None:
        order = Window.partitionBy("doc_id").orderBy("page", "num", "width", "height")
        listed = big.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    first = (
        listed.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("page", "num", "width", "height"))).alias("images"))
    )
    return totals.join(first, "doc_id").withColumn("has_photos", F.col("total_pixels") > photo_pixels)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """One text per document from (doc_id, page, text), a placeholder for failed pages."""
    shown = F.coalesce(F.nullif("text", F.lit("")), F.lit("[OCR failed for this page]"))
    block = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), shown)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page"), block.alias("block"))))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["block"]), "\n\n").alias("text"),
        F.count("*").cast("int").alias("page_count"),
    )
