"""Text routing, chunking, identifiers, parsing and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import ids, markup, names
from corpusgraph.functions import text as tx
from corpusgraph.functions.paging import coerce_page
from corpusgraph.operators import chunking, conversations, extraction
from corpusgraph.operators.search import paginate
from workload.registry import query, table
from workload.standins import DOCS, docs

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def raw(spark, sf):
    return table(spark, sf, "documents")


@query(
    "route_extraction",
    f"""WITH {DOCS} SELECT doc_id, CASE WHEN t IS NULL THEN 'error' WHEN length({TRIM.format('t')}) < 50 THEN 'needs_ocr' ELSE 'completed' END AS route
 FROM (SELECT doc_id, coalesce(text, extracted_text) AS t FROM docs) q""",
)
def route_extraction(spark, sf):
    return docs(spark, sf).select("doc_id", tx.route_extraction(F.coalesce("text", "extracted_text")).alias("route"))


# Image inventory: every line item is an image of its order's file.
IMAGES = """images AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS num,
 CAST(l_quantity * 12 AS INT) AS width, CAST(40 + l_suppkey % 400 AS INT) AS height FROM lineitem)"""


def images(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "l_linenumber AS page", "l_partkey AS num",
        "CAST(l_quantity * 12 AS INT) AS width", "CAST(40 + l_suppkey % 400 AS INT) AS height",
    )


@query(
    "image_summary",
    f"""WITH {IMAGES}, big AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, num, width, height) AS rn FROM images WHERE width >= 100 AND height >= 100)
 SELECT doc_id, count(*) AS image_count, CAST(sum(width * height) AS BIGINT) AS total_pixels, sum(width * height) > 100000 AS has_photos,
  array_to_string(list(page || ':' || num || ':' || width || 'x' || height ORDER BY page, num, width, height), ' ') AS images
 FROM big GROUP BY 1""",
)
def image_summary(spark, sf):
    out = extraction.image_summary(images(spark, sf))
    shown = F.transform(
        "images", lambda i: F.concat(i["page"].cast("string"), F.lit(":"), i["num"].cast("string"), F.lit(":"),
                                     i["width"].cast("string"), F.lit("x"), i["height"].cast("string"))
    )
    return out.withColumn("images", F.array_join(shown, " "))


@query(
    "text_stats",
    """SELECT doc_id, text AS stored_text, length(text) AS text_length, text AS index_text FROM documents""",
)
def text_stats(spark, sf):
    return raw(spark, sf).select("doc_id", tx.text_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


def chunk_sql(size: int, overlap: int) -> str:
    tail = min(500, size)
    return rf"""WITH RECURSIVE w AS (
 SELECT doc_id, text, length(text) AS n, 0 AS start, -1 AS last, 0 AS idx, 0 AS s, 0 AS e, '' AS body FROM documents WHERE length(text) > {size}
 UNION ALL
 SELECT doc_id, text, n, CASE WHEN e2 >= n THEN n WHEN l2 >= 0 AND reach - {overlap} <= l2 THEN reach ELSE reach - {overlap} END,
  l2, CASE WHEN b <> '' THEN idx + 1 ELSE idx END, start, e2, b
 FROM (SELECT *, CASE WHEN b <> '' THEN start ELSE last END AS l2 FROM (
  SELECT *, {TRIM.format('substr(text, start + 1, e2 - start)')} AS b FROM (
   SELECT *, CASE WHEN reach >= n THEN n ELSE reach END AS e2 FROM (
    SELECT *, CASE WHEN start + {size} >= n THEN start + {size} WHEN sl > 0 THEN start + {size - tail} + sl WHEN wl > 0 THEN start + {size - tail} + wl ELSE start + {size} END AS reach FROM (
     SELECT *, length(regexp_extract(substr(text, start + {size - tail} + 1, {tail} + 1), '(?s)^(.*[.!?\n])[ \n\t]', 1)) AS sl,
      length(regexp_extract(substr(text, start + {size - tail} + 1, {tail}), '(?s)^(.*[ \n\t])', 1)) AS wl FROM w WHERE start < n) q1) q2) q3) q4) q5),
 c AS (SELECT doc_id, CAST(idx - 1 AS INT) AS chunk_index, s AS start_char, CAST(e AS INT) AS end_char, body AS text FROM w WHERE body <> ''
  UNION ALL SELECT doc_id, 0, 0, CAST(length(text) AS INT), text FROM documents WHERE length(text) <= {size})
 SELECT doc_id, chunk_index, start_char, end_char, text, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks FROM c"""


@query("chunk_text", chunk_sql(6000, 500))
def chunk_text(spark, sf):
    return chunking.chunk_text(raw(spark, sf).select("doc_id", "text"))


@query("chunk_text_small", chunk_sql(800, 100))
def chunk_text_small(spark, sf):
    return chunking.chunk_text(raw(spark, sf).select("doc_id", "text"), size=800, overlap=100)


@query(
    "assign_point_ids",
    f"""SELECT doc_id, chunk_index, CAST(('0x' || substr(md5(doc_id || '_v2_' || chunk_index), 1, 16))::UBIGINT % 1000000000000000000 AS BIGINT) AS point_id,
 CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text_preview FROM ({chunk_sql(6000, 500)}) q""",
)
def assign_point_ids(spark, sf):
    return chunking.assign_point_ids(chunk_text(spark, sf)).select("doc_id", "chunk_index", "point_id", "text_preview")


@query(
    "assign_hash_ids",
    """SELECT doc_id, CAST(abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) AS BIGINT) AS point_id FROM (
 SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(md5(text), ''), lambda c: ord(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS u
 FROM documents) q""",
)
def assign_hash_ids(spark, sf):
    return raw(spark, sf).select("doc_id", ids.hash_point_id(F.md5("text")).alias("point_id"))


@query(
    "assign_uuid5_ids",
    """SELECT doc_id, u AS uuid, CAST((('0x' || replace(u, '-', ''))::UHUGEINT) % 1000000000000000000 AS BIGINT) AS point_id FROM (
 SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u
 FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || '_text')) AS h FROM documents) a) b""",
)
def assign_uuid5_ids(spark, sf):
    u = ids.uuid5(F.concat(F.col("doc_id").cast("string"), F.lit("_text")))
    return raw(spark, sf).select("doc_id", u.alias("uuid"), ids.uuid_point_id(u).alias("point_id"))


@query(
    "preview",
    """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS p200,
 CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS p2000 FROM documents""",
)
def preview(spark, sf):
    return raw(spark, sf).select("doc_id", tx.preview(F.col("text"), 200).alias("p200"), tx.preview(F.col("text"), 2000).alias("p2000"))


# Analysed documents: people, places and objects are words of the whole text; every fourth and fifth has none.
ANALYSED = r"""analysed AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS document_type,
 CASE WHEN doc_id % 4 > 0 THEN regexp_extract_all(text, '\p{Lu}\p{Ll}+') ELSE [] END AS people,
 CASE WHEN doc_id % 5 > 0 THEN regexp_extract_all(text, '[0-9]+') ELSE [] END AS locations,
 regexp_extract_all(text, '[a-z]{11,}') AS objects FROM documents)"""


def analysed(spark, sf):
    runs = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    none, i = F.array().cast("array<string>"), F.col("doc_id")
    return raw(spark, sf).select(
        "doc_id", "text", F.when(i % 3 == 0, "").otherwise(F.col("lang")).alias("document_type"),
        F.when(i % 4 > 0, runs(r"\p{Lu}\p{Ll}+")).otherwise(none).alias("people"),
        F.when(i % 5 > 0, runs("[0-9]+")).otherwise(none).alias("locations"), runs("[a-z]{11,}").alias("objects"),
    )


@query(
    "embedding_views",
    rf"""WITH {ANALYSED}, v AS (
 SELECT doc_id, 'full_text' AS embedding_type, 'text' AS suffix, text AS body FROM analysed
 UNION ALL SELECT doc_id, 'people', 'people', array_to_string(people, ' | ') FROM analysed
 UNION ALL SELECT doc_id, 'context', 'context', concat_ws('. ', CASE WHEN document_type <> '' THEN 'Document type: ' || document_type END,
  CASE WHEN len(locations) > 0 THEN 'Locations: ' || array_to_string(locations, ', ') END,
  CASE WHEN len(objects) > 0 THEN 'Objects: ' || array_to_string(objects, ', ') END) FROM analysed)
 SELECT doc_id || '_' || suffix AS point_name, doc_id, embedding_type, body AS text FROM v WHERE length({TRIM.format('body')}) >= 20""",
)
def embedding_views(spark, sf):
    return extraction.embedding_views(analysed(spark, sf))


REFUSED = "(" + " OR ".join("contains(lower({0}), '" + p.replace("'", "''") + "')" for p in tx.REFUSAL_PHRASES) + ")"
CANDIDATES = """cand AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('I''m sorry, ', text) WHEN doc_id % 5 = 1 THEN substr(text, 1, 30) ELSE text END AS primary_text,
 CASE WHEN doc_id % 10 = 0 THEN 'EMPTY' WHEN doc_id % 10 = 1 THEN 'empty ' ELSE substr(text, 1, CAST(doc_id % 9 AS INT)) END AS fallback_text FROM documents)"""


def candidates(spark, sf):
    return raw(spark, sf).select(
        "doc_id",
        F.expr("CASE WHEN doc_id % 5 = 0 THEN concat(\"I'm sorry, \", text) WHEN doc_id % 5 = 1 THEN substr(text, 1, 30) ELSE text END").alias("primary_text"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN 'EMPTY' WHEN doc_id % 10 = 1 THEN 'empty ' ELSE substr(text, 1, CAST(doc_id % 9 AS INT)) END").alias("fallback_text"),
    )


@query("is_refusal", f"WITH {CANDIDATES} SELECT doc_id, {REFUSED.format('primary_text')} AS refused FROM cand")
def is_refusal(spark, sf):
    return candidates(spark, sf).select("doc_id", tx.is_refusal(F.col("primary_text")).alias("refused"))


@query(
    "choose_text",
    f"""WITH {CANDIDATES}, p AS (SELECT doc_id, CASE WHEN NOT {REFUSED.format('primary_text')} AND length(primary_text) >= 50 THEN primary_text END AS a,
  CASE WHEN length({TRIM.format('fallback_text')}) > 5 THEN fallback_text END AS b FROM cand)
 SELECT doc_id, CASE WHEN upper(coalesce(a, b)) = 'EMPTY' OR length({TRIM.format('coalesce(a, b)')}) <= 2 THEN '[no visible text]' ELSE coalesce(a, b) END AS text,
  CASE WHEN a IS NOT NULL THEN 'primary' WHEN b IS NOT NULL THEN 'fallback' ELSE 'error' END AS method,
  CASE WHEN a IS NULL AND b IS NULL THEN 'no_text_extracted' END AS error FROM p""",
)
def choose_text(spark, sf):
    chosen = tx.choose_text(F.col("primary_text"), F.col("fallback_text"))
    return candidates(spark, sf).select("doc_id", chosen.alias("c")).select("doc_id", "c.*")


@query(
    "assemble_pages",
    """SELECT conv_id AS doc_id, string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) ||
  CASE WHEN role = 'system' OR text = '' THEN '[OCR failed for this page]' ELSE text END, chr(10) || chr(10) ORDER BY turn, text) AS text,
 CAST(count(*) AS INT) AS page_count FROM conversations GROUP BY 1""",
)
def assemble_pages(spark, sf):
    pages = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.when(F.col("role") != "system", F.col("text")).alias("text")
    )
    return extraction.assemble_pages(pages)


RAW_LABEL = """CASE doc_id % 8 WHEN 0 THEN ' Court Filing.' WHEN 1 THEN 'EMAIL' WHEN 2 THEN 'this is a flight log, I think' WHEN 3 THEN '"letter correspondence"'
 WHEN 4 THEN concat('quality ', quality) WHEN 5 THEN 'legal motion / fbi report' WHEN 6 THEN '`photograph`!' ELSE concat('toxic', toxic, ' other') END"""
_CONTAINED = " ".join(f"WHEN contains(l, '{c}') THEN '{c}'" for c in tx.CATEGORIES)


@query(
    "normalize_label",
    rf"""SELECT doc_id, l AS content_classification, l AS file_type, 'completed' AS classification_status FROM (
 SELECT doc_id, CASE WHEN l IN ({', '.join(repr(c) for c in tx.CATEGORIES)}) THEN l {_CONTAINED} ELSE 'other' END AS l FROM (
  SELECT doc_id, regexp_replace(replace(lower({TRIM.format(RAW_LABEL)}), ' ', '_'), '^[.,;:!?"''`]+|[.,;:!?"''`]+$', '', 'g') AS l FROM labels) a) b""",
)
def normalize_label(spark, sf):
    label = tx.normalize_label(F.expr(RAW_LABEL))
    return table(spark, sf, "labels").select(
        "doc_id", label.alias("content_classification"), label.alias("file_type"), F.lit("completed").alias("classification_status")
    )


# Model answers: strict JSON, JSON inside prose, JSON cut off, and no JSON at all.
_HALF = "CAST(floor(length(text) / 2) AS INT)"
ANSWER_PARTS = f"""regexp_replace(substr(text, 1, {_HALF}), '[^A-Za-z ]', 'x'{{g}}) AS a, regexp_replace(substr(text, {_HALF} + 1), '[^A-Za-z ]', 'x'{{g}}) AS b"""
ANSWER = """CASE doc_id % 4
 WHEN 0 THEN concat('{"people": ["', a, '", 7, "', b, '"], "organizations": [], "locations": ["', b, '"]}')
 WHEN 1 THEN concat('Here is the result: {"people": ["', a, '"], "organizations": ["', b, '", null], "meta": {"n": 1}} as asked')
 WHEN 2 THEN concat('{"people": ["', a, '", "', b, '"], "organizations": ["', b, '"], "locations": ["', a)
 ELSE concat('no entities in ', a) END"""


def answers(spark, sf):
    parts = raw(spark, sf).selectExpr("doc_id", *ANSWER_PARTS.format(g="").replace(" AS a, ", " AS a,\n").split(",\n"))
    return parts.select("doc_id", F.expr(ANSWER).alias("answer"))


@query(
    "parse_entity_json",
    rf"""WITH ans AS (SELECT doc_id, {ANSWER} AS answer FROM (SELECT doc_id, {ANSWER_PARTS.format(g=", 'g'")} FROM documents) p),
 o AS (SELECT *, CASE WHEN json_valid(answer) THEN answer ELSE regexp_extract(answer, '\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}}', 0) END AS obj FROM ans),
 k AS (SELECT doc_id, answer, unnest(['people', 'organizations', 'locations']) AS kind,
   CASE WHEN json_valid(obj) THEN obj END AS js FROM o),
 f AS (SELECT doc_id, kind, CASE WHEN js IS NOT NULL
   THEN list_transform(list_filter(CAST(coalesce(json_extract(js, '$.' || kind), '[]') AS JSON[]), lambda m: json_type(m) = 'VARCHAR'), lambda m: m->>'$')
   ELSE list_transform(regexp_extract_all(regexp_extract(answer, '(?s)"' || kind || '"\s*:\s*\[(.*?)\]', 1), '"([^"]+)"', 1), lambda m: {TRIM.format('m')}) END AS names FROM k)
 SELECT doc_id, array_to_string(max(names) FILTER (kind = 'people'), '|') AS people, array_to_string(max(names) FILTER (kind = 'organizations'), '|') AS organizations,
  array_to_string(max(names) FILTER (kind = 'locations'), '|') AS locations FROM f GROUP BY doc_id HAVING sum(len(names)) > 0""",
)
def parse_entity_json(spark, sf):
    parsed = extraction.entity_lists(answers(spark, sf), "doc_id", "answer")
    return parsed.select("doc_id", *[F.array_join(k, "|").alias(k) for k in extraction.KINDS])


@query(
    "clean_entities",
    rf"""WITH w AS (SELECT doc_id, {TRIM.format('w')} AS name, i FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) q),
 d AS (SELECT doc_id, name, i, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY i) AS rn FROM w WHERE length(name) BETWEEN 3 AND 99),
 r AS (SELECT doc_id, name, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM d WHERE rn = 1)
 SELECT documents.doc_id, coalesce(string_agg(name, '|' ORDER BY i), '') AS names FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id GROUP BY 1""",
)
def clean_entities(spark, sf):
    return raw(spark, sf).select("doc_id", F.array_join(names.clean_entities(F.split("text", " ")), "|").alias("names"))


# Known names: every two words in a row of the even benchmark passages are a person, every word of the odd ones a place.
def known_names(spark, sf):
    words = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    person = F.col("item_id") % 2 == 0
    named = F.when(person & (F.size(words) > 1), pairs).when(~person, words).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "benchmark").select(F.explode(named).alias("name"), F.when(person, "Person").otherwise("Location").alias("kind"))


_TOK = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_NAMED = """named AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END AS names
  FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) b), each_name AS (SELECT item_id, unnest(names) AS name FROM named)"""


@query(
    "gazetteer_entities",
    rf"""WITH {_NAMED}, k AS (SELECT array_to_string({_TOK.format('name')}, ' ') AS gram, item_id % 2 = 0 AS person FROM each_name),
 n AS (SELECT DISTINCT gram FROM k WHERE gram <> '' AND (contains(gram, ' ') OR NOT person)),
 t AS (SELECT doc_id, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' AS joined FROM documents)
 SELECT doc_id, array_to_string(list_transform(string_split(gram, ' '), lambda w: CASE substr(w, 1, 1) WHEN 'ß' THEN 'Ss' ELSE upper(substr(w, 1, 1)) END || substr(w, 2)), ' ') AS name
 FROM t JOIN n ON contains(joined, ' ' || gram || ' ')""",
)
def gazetteer_entities(spark, sf):
    return extraction.gazetteer_entities(raw(spark, sf), known_names(spark, sf))


# Words and what lies between them alternate; a name is a chain of capitalised words with one blank between.
RUNS_SQL = r"""tokens AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM
  (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS t FROM documents) q),
 caps AS (SELECT *, regexp_full_match(token, '\p{Lu}\p{Ll}+') AS cap, lag(token) OVER w AS gap, lag(token, 2) OVER w AS before FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 chains AS (SELECT doc_id, i, token, sum(CASE WHEN gap = ' ' AND regexp_full_match(before, '\p{Lu}\p{Ll}+') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS chain FROM caps WHERE cap),
 runs AS (SELECT doc_id, name, count(*) AS mention_count FROM (SELECT doc_id, string_agg(token, ' ' ORDER BY i) AS name FROM chains GROUP BY doc_id, chain) q
  WHERE length(name) BETWEEN 3 AND 99 GROUP BY 1, 2)"""


@query("capitalized_runs", "WITH " + RUNS_SQL + " SELECT doc_id, name, mention_count FROM runs")
def capitalized_runs(spark, sf):
    return extraction.capitalized_runs(raw(spark, sf))


# An alternation takes the first name that fits at the leftmost place; each hit is set between marks and its place counted.
SPANS_SQL = RUNS_SQL + r""",
 pats AS (SELECT doc_id, '\b(' || string_agg(name, '|' ORDER BY name) || ')\b' AS pattern FROM runs GROUP BY 1),
 marked AS (SELECT doc_id, string_split(regexp_replace(replace(replace(text, chr(1), ' '), chr(2), ' '), pattern, chr(1) || '\1' || chr(2), 'gi'), chr(1)) AS pieces FROM documents JOIN pats USING (doc_id)),
 cut AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM marked),
 placed AS (SELECT doc_id, i, split_part(piece, chr(2), 1) AS hit,
  sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i) - length(replace(piece, chr(2), '')) AS start_char FROM cut)"""


@query(
    "entity_spans",
    f"""WITH {SPANS_SQL} SELECT doc_id, CAST(start_char AS INT) AS start_char, CAST(length(hit) AS INT) AS length,
 (SELECT min(name) FROM runs WHERE runs.doc_id = placed.doc_id AND lower(name) = lower(hit)) AS name FROM placed WHERE i > 1""",
)
def entity_spans(spark, sf):
    return extraction.entity_spans(raw(spark, sf), extraction.capitalized_runs(raw(spark, sf)))


@query(
    "match_count",
    "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'er', ''))) / 2 AS BIGINT) AS matches FROM documents",
)
def match_count(spark, sf):
    return raw(spark, sf).select("doc_id", tx.match_count(F.col("text"), "ER").alias("matches"))


@query(
    "escape_html",
    """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""",
)
def escape_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.escape_html(F.col("html")).alias("escaped"))


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.strip_tags(F.col("html")).alias("plain"))


@query(
    "sanitize_tags",
    r"""SELECT page_id, replace(replace(regexp_replace(replace(replace(regexp_replace(html, '(?i)<li(\s[^>]*)?>', chr(1), 'g'), '</li>', chr(2)), '</LI>', chr(2)), '<[^>]*>', '', 'g'), chr(1), '<li>'), chr(2), '</li>') AS safe FROM pages""",
)
def sanitize_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.keep_tags(F.col("html"), ("li",)).alias("safe"))


@query("paginate", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 20 OFFSET 40")
def page_of_documents(spark, sf):
    return paginate(raw(spark, sf).select("doc_id", "source"), ["source", "doc_id"], *coerce_page("3", "20"))


TITLED = "concat(CASE s_suppkey % 5 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'the  ' WHEN 2 THEN ' MRS ' WHEN 3 THEN 'Sir ' ELSE '' END, s_name, CASE WHEN s_suppkey % 2 = 0 THEN ' (Jr.)' ELSE '-O''Neil ' END)"


@query(
    "normalize_name",
    rf"""SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(lower({TRIM.format(TITLED)}),
 '{names.TITLE_PATTERN}', ''), '[^\p{{L}}\p{{N}}_\s\-'']', '', 'g'), '\s+', ' ', 'g')) AS normalized FROM supplier""",
)
def normalize_name(spark, sf):
    titled = F.expr(TITLED.replace("'-O''Neil '", '"-O\'Neil "'))
    return table(spark, sf, "supplier").select("s_suppkey", names.normalize_name(titled).alias("normalized"))


# Analysis texts: two blocks and three bullet lines made of the document's words.
BLOCKS = r"""concat('FINDING: ', CASE WHEN doc_id % 30 < 8 THEN substr(text, 1, CAST(doc_id % 30 AS INT)) ELSE text END, '{n}CONFIDENCE: ', CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'Medium' ELSE 'LOW' END,
 '{n}TYPE: ', CASE doc_id % 4 WHEN 0 THEN 'Timeline Event' WHEN 1 THEN 'claim' ELSE lang END, '{n}ENTITIES: ', source, ', none, ', lang, '{n}{n}finding: Second finding of ', source,
 '{n}DESCRIPTION: about ', source, ': more{n}{n}no keys here')"""


@query(
    "parse_findings",
    rf"""WITH a AS (SELECT doc_id, {BLOCKS.replace('{n}', "' || chr(10) || '")} AS analysis FROM (SELECT doc_id, regexp_replace(text, '\s', ' ', 'g') AS text, lang, source FROM documents) d),
 b AS (SELECT doc_id, unnest(string_split(analysis, chr(10) || chr(10))) AS block, generate_subscripts(string_split(analysis, chr(10) || chr(10)), 1) - 1 AS block_no FROM a),
 l AS (SELECT doc_id, block_no, unnest(string_split(block, chr(10))) AS line FROM b),
 kv AS (SELECT doc_id, block_no, upper(trim(split_part(line, ':', 1))) AS k, trim(substr(line, strpos(line, ':') + 1)) AS v FROM l WHERE contains(line, ':')),
 p AS (SELECT doc_id, block_no, max(v) FILTER (k = 'FINDING') AS title, max(v) FILTER (k = 'CONFIDENCE') AS c, max(v) FILTER (k = 'TYPE') AS t,
  max(v) FILTER (k = 'ENTITIES') AS e, max(v) FILTER (k = 'DESCRIPTION') AS d FROM kv GROUP BY 1, 2)
 SELECT doc_id AS analysis_id, CAST(block_no AS INT) AS block_no, title, coalesce(d, title) AS description,
  CASE upper(coalesce(c, 'MEDIUM')) WHEN 'HIGH' THEN 0.85::DOUBLE WHEN 'MEDIUM' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  CASE WHEN replace(lower(coalesce(t, 'pattern')), ' ', '_') IN ({', '.join(repr(x) for x in extraction.FINDING_TYPES)}) THEN replace(lower(coalesce(t, 'pattern')), ' ', '_') ELSE 'pattern' END AS finding_type,
  coalesce(array_to_string(list_filter(list_transform(string_split(e, ','), lambda x: trim(x)), lambda x: x <> '' AND upper(x) <> 'NONE'), '|'), '') AS entities
 FROM p WHERE length(title) >= 5""",
)
def parse_findings(spark, sf):
    flat = raw(spark, sf).withColumn("text", F.regexp_replace("text", r"\s", " "))
    analyses = flat.select(F.col("doc_id").alias("analysis_id"), F.expr(BLOCKS.replace("{n}", "\\n")).alias("analysis"))
    return extraction.parse_findings(analyses).withColumn("entities", F.array_join("entities", "|"))


BULLETS = r"""concat('intro line{n}- ', substr(text, 1, CAST(floor(length(text) / 2) AS INT)), '{n}continued ', source, '{n}2) ', CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 9) ELSE text END, '{n}* ', substr(text, CAST(floor(length(text) / 2) AS INT) + 1), '{n}end of ', lang)"""


@query(
    "parse_findings_naive",
    rf"""WITH a AS (SELECT doc_id, {BULLETS.replace('{n}', "' || chr(10) || '")} AS analysis FROM (SELECT doc_id, regexp_replace(text, '\s', ' ', 'g') AS text, lang, source FROM documents) d),
 l AS (SELECT doc_id, {TRIM.format('line')} AS line, i FROM (SELECT doc_id, unnest(string_split(analysis, chr(10))) AS line, generate_subscripts(string_split(analysis, chr(10)), 1) AS i FROM a) q),
 g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(?:[0-9]|- |\* )') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS item FROM l),
 j AS (SELECT doc_id, item, {TRIM.format("string_agg(line, ' ' ORDER BY i)")} AS description, min_by(line, i) AS head FROM g WHERE item > 0 GROUP BY 1, 2)
 SELECT doc_id AS analysis_id, CAST(item - 1 AS INT) AS item_no, regexp_replace(head, '^[0-9.\-*) ]+', '') AS title, description, 0.7::DOUBLE AS confidence FROM j WHERE length(description) >= 20""",
)
def parse_findings_naive(spark, sf):
    flat = raw(spark, sf).withColumn("text", F.regexp_replace("text", r"\s", " "))
    analyses = flat.select(F.col("doc_id").alias("analysis_id"), F.expr(BULLETS.replace("{n}", "\\n")).alias("analysis"))
    return extraction.parse_findings_naive(analyses)


@query(
    "effective_text",
    f"WITH {DOCS} SELECT doc_id, coalesce(nullif(text, ''), nullif(extracted_text, '')) AS body FROM docs",
)
def effective_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.effective_text(F.col("text"), F.col("extracted_text")).alias("body"))


@query(
    "context_window",
    """SELECT conv_id, turn, role, text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down FROM conversations) q WHERE n <= 6 OR up = 1 OR down <= 5""",
)
def context_window(spark, sf):
    return conversations.context_window(table(spark, sf, "conversations"))


@query(
    "valid_conversations",
    """SELECT conv_id, turn, role, text FROM (SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS opener FROM conversations
 WHERE role IN ('user', 'assistant')) q WHERE opener = 'user'""",
)
def valid_conversations(spark, sf):
    return conversations.valid_conversations(table(spark, sf, "conversations"))
