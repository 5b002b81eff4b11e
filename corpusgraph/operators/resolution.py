"""Entity resolution: candidates, scores, groups, merged graph.

Candidate pairs are not all pairs of a block.  Names are first reduced to
distinct normalised forms (equal forms match at similarity 1 through a chain,
not pairwise).  Blocks of forms meet where their lengths allow a match; two
forms can only reach the similarity threshold if they share enough characters,
which is told for whole blocks at once; the bound is exact, no matching pair is
lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.formpairs import Forms, needed
from corpusgraph.functions.names import normalize_name
from corpusgraph.functions.similarity import jaro_winkler
from corpusgraph.operators.algorithms import connected_components
from corpusgraph.operators.graph import MENTIONED
from corpusgraph.session import broadcast_if_small, cut_lineage, spread, written

MATCH = 0.95
AMBIGUOUS = 0.85
#: Forms of a block; two blocks are compared at a time.
PART_FORMS = 8192


def block_keys(entities: DataFrame, above: int | None = None, sorted_words: bool = False) -> DataFrame:
    """(id, label, name, normalized, block).

    All names of a label are one block, at any size: ``candidate_forms``
    loses no pair.  Only with ``above`` given, a label with
    more entities than that is compared within first characters.
    """
    named = entities.where(F.length(F.trim("name")) > 0).withColumn("normalized", normalize_name(F.col("name")))
    if sorted_words:
        named = named.withColumn("normalized", F.array_join(F.array_sort(F.split("normalized", " ")), " "))
    if above is None:
        return named.withColumn("block", F.lit(""))
    # One row per label: the label set is the fixed list of entity kinds.
    sizes = named.groupBy("label").agg(F.count("*").alias("label_size"))
    first = F.when(F.col("normalized") == "", "_").otherwise(F.substring("normalized", 1, 1))
    return (
        named.join(broadcast_if_small(sizes), "label")
        .withColumn("block", F.when(F.col("label_size") > above, first).otherwise(""))
        .drop("label_size")
    )


#: Size classes: the length itself up to this one, quarters of a doubling beyond.
OWN_CLASS = 16
#: Block pairs per task, and the 64-bit words of a document signature.
PAIRS_PER_TASK = 128
SIGNATURE_WORDS = 4
WORDS = [f"w{i}" for i in range(SIGNATURE_WORDS)]
#: Most entities whose document sets are sent to every task.
SIGNED_ROWS = 500_000


def _block_pairs(keyed: DataFrame, threshold: float, part_rows: int) -> DataFrame:
    """(label, block, ours, theirs): blocks of about ``part_rows`` distinct forms whose sizes allow a pair above the threshold.

    ``theirs`` is null where a block meets itself.  The rows carry the forms, so
    a task holds two blocks at a time, each form with its document signature if
    ``keyed`` has one.
    """
    words = [c for c in WORDS if c in keyed.columns]
    named = keyed.where("normalized <> ''").select("label", "block", F.col("normalized").alias("form"), *words)
    forms = named.groupBy("label", "block", "form").agg(*[F.bit_or(c).alias(c) for c in words]) if words else named.distinct()
    n = F.length("form")
    above = OWN_CLASS + F.ceil(4 * F.log2(n / OWN_CLASS)).cast("int")
    forms = cut_lineage(forms.withColumn("size", F.when(n <= OWN_CLASS, n).otherwise(above)))
    parts = forms.groupBy("label", "block", "size").agg(
        F.ceil(F.count("*") / part_rows).alias("parts"), F.min(F.length("form")).alias("low"), F.max(F.length("form")).alias("high")
    )
    # One row per label, block and size.
    placed = forms.join(broadcast_if_small(parts.select("label", "block", "size", "parts")), ["label", "block", "size"]).withColumn(
        "part", F.pmod(F.xxhash64("form"), F.col("parts"))
    )
    key = ["label", "block", "size", "part"]
    packed = cut_lineage(spread(placed, *key).groupBy(*key).agg(F.collect_list(F.struct("form", *words)).alias("forms")))
    blocks = parts.select("label", "block", "size", "low", "high", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    mine = blocks.select("label", "block", *[F.col(c).alias(f"{c}1") for c in ("size", "part", "high")])
    other = blocks.select("label", "block", *[F.col(c).alias(f"{c}2") for c in ("size", "part", "low")])
    ordered = (F.col("size1") < F.col("size2")) | (F.col("size1") == F.col("size2")) & (F.col("part1") <= F.col("part2"))
    # With all of the shorter form matched m/|a| + m/|b| is 1 + |a|/|b|.
    fits = F.least(F.col("high1") / F.col("low2"), F.lit(1.0)) + 1 >= needed(threshold, 4) - 1e-9
    pairs = cut_lineage(mine.join(other, ["label", "block"]).where(ordered & fits).drop("high1", "low2"))
    tasks = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS_PER_TASK))
    pairs = pairs.withColumn("same", (F.col("size1") == F.col("size2")) & (F.col("part1") == F.col("part2")))
    ours = packed.select("label", "block", F.col("size").alias("size1"), F.col("part").alias("part1"), F.col("forms").alias("ours"))
    theirs = packed.select("label", "block", F.col("size").alias("size2"), F.col("part").alias("part2"), F.col("forms").alias("theirs"))
    met = pairs.join(ours, ["label", "block", "size1", "part1"]).join(theirs, ["label", "block", "size2", "part2"])
    met = met.withColumn("theirs", F.when(~F.col("same"), F.col("theirs")))
    return met.repartition(tasks, "label", "block", "size1", "part1", "size2", "part2").select("label", "block", "ours", "theirs")


def _met(keyed: DataFrame, threshold: float, part_rows: int, scored: bool, alone: float | None = None) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                label, block = (batch.column(c)[at].as_py() for c in ("label", "block"))
                sides = [batch.column(c)[at].values for c in ("ours", "theirs") if batch.column(c)[at].is_valid]
                both = Forms([form for side in sides for form in side.field("form").to_pylist()])
                sets = None
                if alone is not None:
                    sets = np.stack([np.concatenate([side.field(w).to_numpy() for side in sides]) for w in WORDS], axis=1)
                forms = pa.array(both.forms, pa.string())
                for i, j in both.candidates(len(sides[0]) if len(sides) > 1 else 0, threshold, sets, alone):
                    out = []
                    if scored:
                        similarity = both.scores(i, j)
                        kept = similarity >= threshold
                        if sets is not None:
                            kept &= (similarity >= alone) | (sets[i] & sets[j]).any(axis=1)
                        i, j, out = i[kept], j[kept], [pa.array(similarity[kept])]
                    if len(i):
                        fixed = [pa.repeat(pa.scalar(v, pa.string()), len(i)) for v in (label, block)]
                        names = ["label", "block", "a", "b", "similarity"][: 4 + len(out)]
                        yield pa.RecordBatch.from_arrays([*fixed, forms.take(pa.array(i)), forms.take(pa.array(j)), *out], names=names)

    schema = "label string, block string, a string, b string" + (", similarity double" if scored else "")
    return _block_pairs(keyed, threshold, part_rows).mapInArrow(compare, schema)


def candidate_forms(keyed: DataFrame, threshold: float = AMBIGUOUS, part_rows: int = PART_FORMS) -> DataFrame:
    """Pairs (label, block, a, b) of distinct normalised forms that may reach the threshold, ``a`` before ``b``.

    With m matching characters Jaro is at most (m/|a| + m/|b| + 1)/3, so a pair
    above the threshold needs m/|a| + m/|b| >= need, where need falls with the
    number of equal leading characters.  The common (character, occurrence)
    marks of two forms bound m; for two blocks of forms their counts are one
    matrix product.  The bound is exact, no matching pair is lost.
    """
    return _met(keyed, threshold, part_rows, scored=False)


def similar_forms(keyed: DataFrame, threshold: float = AMBIGUOUS, part_rows: int = PART_FORMS) -> DataFrame:
    """The candidates with similarity of at least ``threshold``, scored in the task that finds them."""
    return _met(keyed, threshold, part_rows, scored=True)


def linkable_forms(keyed: DataFrame, seen: DataFrame, match: float = MATCH, ambiguous: float = AMBIGUOUS, part_rows: int = PART_FORMS) -> DataFrame:
    """The pairs of ``similar_forms`` that can link entities: sure ones, and those whose entities may share a document.

    ``seen`` is (id, dst).  Every form carries a hashed set of the documents of
    its entities; sets without a common bit have no common document.  Most
    pairs of the ambiguous band end there, in the task that finds them: their
    number grows with the square of the forms and is never written.
    """
    who = keyed.where("normalized <> ''").select("label", "block", "normalized", "id")
    signed = who.join(seen, "id", "left").groupBy("label", "block", "normalized").agg(
        *[F.coalesce(F.bit_or(word), F.lit(0).cast("bigint")).alias(c) for c, word in zip(WORDS, _signature_words())]
    )
    return _met(signed, ambiguous, part_rows, scored=True, alone=match)


def _signature_words() -> list[Column]:
    """The words of a set of one document, of column ``dst``."""
    bit = F.pmod(F.xxhash64("dst"), F.lit(64 * SIGNATURE_WORDS)).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit % 64)
    return [F.when(F.col("dst").isNotNull(), F.when(F.floor(bit / 64) == w, mark).otherwise(F.lit(0).cast("bigint"))) for w in range(SIGNATURE_WORDS)]


def score_forms(candidates: DataFrame) -> DataFrame:
    """Jaro-Winkler similarity of each candidate pair of forms."""
    return candidates.withColumn("similarity", jaro_winkler("a", "b"))


def score_pairs(keyed: DataFrame, threshold: float = AMBIGUOUS, floor: float | None = AMBIGUOUS) -> DataFrame:
    """All entity pairs of a block with similarity of at least ``threshold``, scored.

    Pairs with equal forms are included at similarity 1.
    """
    keyed = cut_lineage(keyed)
    if floor is None:
        scored = score_forms(candidate_forms(keyed, threshold))
    else:
        scored = similar_forms(keyed, threshold).where(F.col("similarity") >= floor)
    who = keyed.where("normalized <> ''").select("label", "block", F.col("normalized").alias("form"), "id")
    far = (
        scored.join(who.select("label", "block", F.col("form").alias("a"), F.col("id").alias("x")), ["label", "block", "a"])
        .join(who.select("label", "block", F.col("form").alias("b"), F.col("id").alias("y")), ["label", "block", "b"])
        .select("label", "x", "y", "similarity")
    )
    same = (
        who.withColumnRenamed("id", "x").join(who.withColumnRenamed("id", "y"), ["label", "block", "form"])
        .where("x < y").select("label", "x", "y", F.lit(1.0).alias("similarity"))
    )
    pairs = far.unionByName(same)
    return pairs.select("label", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def share_document(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """The pairs (id_a, id_b) whose entities occur in a common document.

    Hashed sets of documents rule out most pairs of rare entities; what is left
    is expanded by the documents of the rarer member only.
    """
    return _share_seen(pairs, _seen(mentions))


def _seen(mentions: DataFrame) -> DataFrame:
    """(id, dst): the documents of each entity, written once."""
    return written(mentions.select(F.col("src").alias("id"), "dst").distinct())


def _share_seen(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    # A null is no document.
    words = [F.coalesce(F.bit_or(word), F.lit(0).cast("bigint")) for word in _signature_words()]
    count = seen.groupBy("id").agg(F.count("*").alias("n"), F.array(*words).alias("s"))
    count = broadcast_if_small(cut_lineage(count), SIGNED_ROWS)
    sized = pairs.join(count.select(F.col("id").alias("id_a"), F.col("n").alias("na"), F.col("s").alias("sa")), "id_a").join(
        count.select(F.col("id").alias("id_b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "id_b"
    )
    both = [F.col("sa")[w].bitwiseAND(F.col("sb")[w]) for w in range(SIGNATURE_WORDS)]
    sized = sized.where(reduce(lambda x, y: x.bitwiseOR(y), both) != 0)
    swapped = F.col("na") > F.col("nb")
    probe = sized.select(
        F.when(swapped, F.col("id_b")).otherwise(F.col("id_a")).alias("rare"),
        F.when(swapped, F.col("id_a")).otherwise(F.col("id_b")).alias("common"), swapped.alias("swapped"),
    )
    docs = probe.join(seen.withColumnRenamed("id", "rare"), "rare")
    shared = docs.join(seen.withColumnRenamed("id", "common"), ["common", "dst"], "left_semi").select("rare", "common", "swapped").distinct()
    ends = [F.when(F.col("swapped"), F.col(x)).otherwise(F.col(y)).alias(c) for c, x, y in (("id_a", "common", "rare"), ("id_b", "rare", "common"))]
    return shared.select(*ends)


def match_links(keyed: DataFrame, mentions: DataFrame, match: float = MATCH, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """Links (src, dst) whose transitive closure is the merge relation.

    Equal forms are chained to their smallest id instead of paired, and a sure
    match of two forms links one entity of each; the ambiguous band needs every
    entity pair, as each must share a document itself.
    """
    keyed, seen = written(keyed.select("label", "block", "normalized", "id")), _seen(mentions)
    scored = written(linkable_forms(keyed, seen, match, ambiguous))
    who = keyed.where("normalized <> ''").select("label", "block", F.col("normalized").alias("form"), "id")
    head = who.groupBy("label", "block", "form").agg(F.min("id").alias("head"))
    same = who.join(head, ["label", "block", "form"]).where("id <> head").select(F.col("id").alias("src"), F.col("head").alias("dst"))

    def of(rows: DataFrame, form: str, value: str, name: str) -> DataFrame:
        return rows.select("label", "block", F.col("form").alias(form), F.col(value).alias(name))

    key = ["label", "block"]
    sure = scored.where(F.col("similarity") >= match)
    sure = sure.join(of(head, "a", "head", "src"), [*key, "a"]).join(of(head, "b", "head", "dst"), [*key, "b"]).select("src", "dst")
    unsure = scored.where(F.col("similarity") < match)
    unsure = unsure.join(of(who, "a", "id", "id_a"), [*key, "a"]).join(of(who, "b", "id", "id_b"), [*key, "b"]).select("id_a", "id_b")
    backed = _share_seen(unsure, seen).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    return same.unionByName(sure).unionByName(backed)


def match_pairs(scored: DataFrame, mentions: DataFrame, match: float = MATCH, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """Scored entity pairs that match: surely, or in the ambiguous band with a shared document."""
    scored = cut_lineage(scored)  # read three times
    sure = scored.where(F.col("similarity") >= match)
    unsure = scored.where((F.col("similarity") >= ambiguous) & (F.col("similarity") < match))
    backed = unsure.join(share_document(unsure.select("id_a", "id_b"), mentions), ["id_a", "id_b"], "left_semi")
    return sure.unionByName(backed.select(*sure.columns))


def merge_groups(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group): the transitive closure of the links, named by its smallest id."""
    return connected_components(entities.select("id"), links).withColumnRenamed("component", "group")


def canonicalize(entities: DataFrame, groups: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row per group of two or more: canonical id and name, sorted aliases.

    The member with the most relationships is canonical, ties go to the
    smallest id.  ``entities`` may carry an ``aliases`` array, which is kept.
    """
    known = F.col("aliases") if "aliases" in entities.columns else F.array().cast("array<string>")
    rows = (
        entities.select("id", F.trim("name").alias("name"), F.coalesce(known, F.array().cast("array<string>")).alias("aliases"))
        .join(groups, "id").join(degrees.select("id", "connections"), "id", "left")
        .withColumn("connections", F.coalesce("connections", F.lit(0).cast("bigint")))
    )
    best = rows.groupBy("group").agg(
        F.max_by(F.struct("id", "name"), F.struct("connections", -F.col("id"))).alias("c"), F.count("*").alias("members")
    ).where("members > 1")
    # Distinct names before they are gathered: a group keeps its aliases by definition.
    names = rows.select("group", F.explode(F.array_append("aliases", F.col("name"))).alias("alias")).distinct()
    listed = names.join(best, "group").where(F.col("alias") != F.col("c.name")).groupBy("group").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return best.join(listed, "group", "left").select(
        "group", F.col("c.id").alias("canonical_id"), F.col("c.name").alias("canonical_name"), "members",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def canonical_map(groups: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, canonical_id) of every entity that is merged into another."""
    return groups.join(canonical.select("group", "canonical_id"), "group").where("id <> canonical_id").select("id", "canonical_id")


def rewrite_edges(edges: DataFrame, mapping: DataFrame, simple: bool = False) -> DataFrame:
    """Edges with both ends moved to the canonical entity, self loops dropped, unique.

    ``simple`` keeps only the outgoing MENTIONED_IN edges of merged entities.
    """
    src = mapping.select(F.col("id").alias("src"), F.col("canonical_id").alias("new_src"))
    dst = mapping.select(F.col("id").alias("dst"), F.col("canonical_id").alias("new_dst"))
    moved = edges.join(src, "src", "left").join(dst, "dst", "left")
    if simple:
        touched = F.col("new_src").isNotNull() | F.col("new_dst").isNotNull()
        fine = (F.col("type") == MENTIONED) & F.col("new_dst").isNull()
        moved = moved.where(~touched | fine)
    return (
        moved.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "type", "count")
        .where("src <> dst").groupBy("src", "dst", "type").agg(F.max("count").alias("count"))
    )


def resolution_report(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per label: original, merged, remaining and the reduction in percent."""
    joined = entities.select("id", "label").join(mapping, "id", "left")
    return joined.groupBy("label").agg(F.count("*").alias("original"), F.count("canonical_id").alias("merged")).select(
        "label", "original", "merged", (F.col("original") - F.col("merged")).alias("remaining"),
        F.round(F.lit(100.0) * F.col("merged") / F.col("original"), 1).alias("reduction_pct"),
    )


def sync_entities(existing: DataFrame, graph_entities: DataFrame) -> DataFrame:
    """Upsert by (entity_type, canonical_name): aliases of known entities are overwritten.

    ``existing`` is (id, entity_type, canonical_name, aliases), ``graph_entities``
    (id, label, name, aliases); new rows keep the graph id.
    """
    incoming = (
        graph_entities.where(F.length(F.trim("name")) > 0)
        .groupBy(F.lower("label").alias("entity_type"), F.trim("name").alias("canonical_name"))
        .agg(F.min("id").alias("new_id"), F.min_by("aliases", "id").alias("new_aliases"))
    )
    action = F.when(F.col("id").isNull(), "inserted").when(F.col("new_id").isNull(), "kept").otherwise("updated")
    return existing.join(incoming, ["entity_type", "canonical_name"], "full_outer").select(
        F.coalesce("id", "new_id").alias("id"), "entity_type", "canonical_name",
        F.coalesce("new_aliases", "aliases").alias("aliases"), action.alias("action"),
    )


def sync_mentions(existing: DataFrame, graph_mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upserted (doc_id, entity_id, mention_count) and the count of skipped rows.

    ``graph_mentions`` is (label, name, doc_id, mention_count); a mention whose
    entity is unknown is skipped and counted.
    """
    keyed = graph_mentions.select(
        F.lower("label").alias("entity_type"), F.trim("name").alias("canonical_name"), "doc_id", "mention_count"
    )
    matched = keyed.join(entities.select("entity_type", "canonical_name", F.col("id").alias("entity_id")), ["entity_type", "canonical_name"], "left")
    skipped = matched.agg(F.count_if(F.col("entity_id").isNull()).alias("skipped"), F.count("entity_id").alias("upserted"))
    fresh = matched.where("entity_id IS NOT NULL").groupBy("doc_id", "entity_id").agg(F.max("mention_count").alias("new_count"))
    merged = existing.join(fresh, ["doc_id", "entity_id"], "full_outer").select(
        "doc_id", "entity_id", F.coalesce("new_count", "mention_count").alias("mention_count")
    )
    return merged, skipped
