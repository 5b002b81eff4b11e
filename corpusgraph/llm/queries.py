"""The registered queries of the pipeline operators, with SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgraph.llm import ann, decontam, hardneg, html, linededup, mixing, ngramjoin, packing, pii, quality, secrets, sharding, veccodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf, "documents"))


_KEY = r"translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_line_dedup", rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, coalesce(h.stays <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), least=20, times=3, keep="last")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WORDS = r"[x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+') if x <> '']"


@query("op6_jaccard_join", rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common
           FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, near) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.id, s.b FROM reach r JOIN sides s ON s.a = r.near)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT id, min(near) AS component_id FROM reach GROUP BY id) c ON c.id = s.doc_id""")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf, "documents"), words=4, percent=85)


@query("op3_main_text")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = html.extract_text(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op4_shards")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")
    )
    return sharding.shard_rows(slim, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: Target shares of tokens by domain of the labelled table.
WEIGHTS = {"clean": 0.8, "junk": 0.1, "toxic": 0.1}


@query("op5_mixing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    labelled = mixing.domains(table(spark, sf, "labels"))
    rates = mixing.mix_rates(table(spark, sf, "documents"), labelled, WEIGHTS)
    return rates.select("doc_id", "tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(WEIGHTS)), "rate", "copies")


@query("op7_quality")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.graded(table(spark, sf, "labels")))
    rated = quality.rate(docs, model)
    return rated.select(
        "doc_id", "expected_grade", F.col("tails")[0].alias("p_above_harmful"), F.col("tails")[1].alias("p_good"),
        quality.accepted(F.col("tails")).alias("keep"),
    )


@query("op10_decontamination")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


@query("op9_neighbours")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return ann.neighbours(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


@query("op8_surrogates")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"), F.transform("pii", lambda x: x.kind).alias("kinds"))


#: Usable vectors, as doubles: every integer here is far below 2^53.
_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_PRODUCT = "list_dot_product(a.c, b.c)"


def _codes_sql(rounds: int = 4, parts: int = 4) -> str:
    """Exact k-means over the parts, one set of CTEs per round."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE})),
cut AS MATERIALIZED (SELECT r, p, c, list_dot_product(c, c) AS norm FROM (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS c FROM kept, range({parts}) AS t(p))),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, c, norm FROM cut WHERE r <= 256)"""]
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (SELECT a.r, a.p, min(CAST(a.norm + b.norm - 2 * {_PRODUCT} AS BIGINT) * 256 + b.e) AS best
  FROM cut a JOIN book{i} b ON a.p = b.p GROUP BY a.r, a.p)""")
        if i < rounds:
            steps.append(f"""
mean{i} AS (SELECT p, e, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS c FROM (
  SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (
    SELECT c.p, n.best % 256 AS e, unnest(c.c) AS x, generate_subscripts(c.c, 1) AS i FROM cut c JOIN near{i} n ON c.r = n.r AND c.p = n.p) GROUP BY p, e, i) GROUP BY p, e),
book{i + 1} AS MATERIALIZED (SELECT p, e, c, list_dot_product(c, c) AS norm FROM (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON b.p = m.p AND b.e = m.e))""")
    return "WITH " + ",".join(steps) + f""",
coded AS (SELECT k.vec_id, k.label, n.code, n.error FROM kept k JOIN (
  SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY r) n ON k.r = n.r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM (
    SELECT p, e, CAST(unnest(c) AS BIGINT) AS x, generate_subscripts(c, 1) AS i FROM book{rounds})) AS codebooks_sha256
FROM coded"""


@query("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return veccodes.compress(table(spark, sf, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


@query("op12_packing")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers  # where the box keeps vocabulary files; the operator takes any path

    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=1)


@query("op13_hard_negatives", f"""
WITH kept AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST({_PRODUCT} AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT anchor_id, vec_id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM near p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    label = F.col("label").cast("long")
    mixed = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hardneg.mine(mixed, F.col("vec_id") % 50 == 0, positives=5, negatives=3, least=50, most=95, scale=256)
