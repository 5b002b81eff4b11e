"""HTML extraction with a site style tree.

The DOMs of one host are merged by node path (tags with class and id). An
element node's importance is the entropy of its presentation styles, that is of
its sequences of children; a content node's falls with the entropy of its
features, that is with the spread of each text over the host's pages. Branches
below a threshold, with all that is in them, are menus, notices and other
template parts and are removed from every page of the host, unless a branch
holds most of what varies there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.binding import let
from corpusgraph.llm.common import rows_of, stored
from corpusgraph.session import broadcast_if_small

# Elements by what HTML says of them.
NO_TEXT = frozenset("script style noscript template iframe object svg canvas math head title select option datalist button input textarea audio video map".split())
NOISE = frozenset("nav footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose start ends an open p; an open item ends at the next of its kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names in class, id or role that mark template parts.
NOISE_NAME = re.compile(
    r"(?i)(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|masthead|banner|ads?|advert|adverts|advertisement|adbox|sponsor|sponsored|promo|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|commentlist|discussion|respond|replies|widget|pagination|pager|toolbar|skip|copyright|disclaimer|complementary|contentinfo|search)(?:$|[\s_-]|\d)"
)
CONTENT = frozenset(["article", "main"])

#: Pages of a host below which its tree says nothing, and least importance of a branch outside an article.
LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.3
#: Share of what varies on a host from which a branch is content, however many constant parts it has.
MOST_VARIED = 0.5
#: Share of an article's characters that is left when its template parts go; with less it is a near copy.
LEAST_LEFT = 0.5
#: Stands for all of a host's paths.
WHOLE = "*"
#: Most hosts whose template parts travel to every task.
HOSTS = 100_000
#: Weight of a node's own presentation in its composite importance.
OWN_WEIGHT = 0.1


class PageTree(HTMLParser):
    """Collects text blocks with their paths, and the child sequences of element nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, bool, bool, list]] = []  # tag, path, noise, content, child labels
        self.blocks: list[tuple[str, str, bool]] = []
        self.styles: set[tuple[str, int]] = set()
        self.text: list[str] = []
        self.place = ("", False, False)

    def flush(self):
        if self.text:
            block = " ".join("".join(self.text).split())
            path, noise, content = self.place
            if block and not noise:
                self.blocks.append((path, block, content))
            self.text = []

    def close_top(self):
        tag, path, noise, content, children = self.stack.pop()
        if not noise and children:
            run = [c for i, c in enumerate(children) if not i or children[i - 1] != c]
            self.styles.add((path, xxhash.xxh3_64_intdigest(" ".join(run)) >> 1))

    def close_at(self, depth: int):
        self.flush()
        while len(self.stack) > depth:
            self.close_top()

    def handle_starttag(self, tag, attrs):
        if tag in INLINE and not any(k in ("class", "id", "role") and v and NOISE_NAME.search(v) for k, v in attrs):
            if tag in ("br", "img", "wbr") and self.text and tag == "br":
                self.text.append(" ")
            return
        if tag in VOID:
            self.flush()
            return
        if tag in ENDS_P:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self.close_at(i)
                    break
                if self.stack[i][0] not in INLINE:
                    break
        if tag in SIBLINGS:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in SIBLINGS[tag]:
                    self.close_at(i)
                    break
                if self.stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
        self.flush()
        named = dict(attrs)
        names = " ".join(v for k in ("class", "id", "role") if (v := named.get(k)))
        label = tag + ("." + re.sub(r"\d+", "0", "-".join(names.split())) if names else "")
        up = self.stack[-1] if self.stack else ("", "", False, False, [])
        up[4].append(label)
        noise = (
            up[2] or tag in NO_TEXT or tag in NOISE or "hidden" in named or named.get("aria-hidden") == "true"
            or (tag == "header" and not up[3]) or (tag not in ("html", "body") and bool(names) and bool(NOISE_NAME.search(names)))
        )
        self.stack.append((tag, f"{up[1]}>{label}"[-2000:], noise, up[3] or tag in CONTENT or "main" == named.get("role"), []))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.close_at(i)
                return
            # An end tag inside a block does not close elements around an article.
            if self.stack[i][0] in ("article", "main", "body") and tag not in ("html", "body"):
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in NO_TEXT:
            return
        if not self.text:
            top = self.stack[-1] if self.stack else ("", "", False, False, [])
            self.place = (top[1], top[2], top[3])
        self.text.append(data)

    @classmethod
    def read(cls, html: str | None) -> PageTree:
        page = cls()
        page.feed(html or "")
        page.close()
        page.close_at(0)
        return page


def page_trees(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, blocks, styles, digest`` per page; null html is an empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("inside", pa.bool_())]))
        style = pa.list_(pa.struct([("path", pa.string()), ("style", pa.int64())]))
        for whole in batches:
            for batch in rows_of(whole, 128):
                blocks, styles = [], []
                for html in batch.column("html").to_pylist():
                    page = PageTree.read(html)
                    blocks.append([{"path": p, "text": t, "inside": c} for p, t, c in page.blocks])
                    styles.append([{"path": p, "style": s} for p, s in sorted(page.styles)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(blocks, block), pa.array(styles, style)],
                    names=["page_id", "url", "host", "blocks", "styles"],
                )

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    schema = "page_id long, url string, host string, blocks array<struct<path:string,text:string,inside:boolean>>, styles array<struct<path:string,style:long>>"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html").mapInArrow(run, schema)


def style_tree(trees: DataFrame) -> DataFrame:
    """``host, path, pages, importance, varied``: the merged tree of each host, every prefix of a text's path.

    ``pages`` have a text at or below the path. ``varied`` adds up the
    importance of the distinct texts there; path ``WHOLE`` is the whole host.
    Copies of a page count once, so that a host of many copies does not make
    its articles look like a template. All sums are partial aggregates; no host
    meets in one task.
    """
    texts = F.transform("blocks", lambda b: F.xxhash64(b.text))
    once = trees.select("host", "blocks", "styles", F.xxhash64(texts).alias("copy"))
    # One row per host and distinct page: the hashes are all that is shuffled.
    slim = once.select(
        "host", "copy",
        F.array_distinct(F.transform("blocks", lambda b: F.struct(b.path.alias("path"), F.xxhash64(b.text).alias("feature")))).alias("features"),
        "styles",
    ).dropDuplicates(["host", "copy"])
    slim = stored(slim, "style-pages")
    content = slim.select("host", F.explode("features").alias("x")).select("host", "x.path", "x.feature")
    spread = content.groupBy("host", "path", "feature").agg(F.count("*").alias("n"))
    # Text under no element has the path '' and is below WHOLE only. A page's prefixes travel as hashes.
    parts = lambda p: F.split(p, ">")
    steps = lambda p: F.sequence(F.when(F.size(parts(p)) < 2, 1).otherwise(2), F.size(parts(p)))
    depth = lambda p: F.concat(F.array(F.lit(WHOLE)), F.transform(steps(p), lambda k: F.array_join(F.slice(parts(p), 1, k), ">")))
    met = F.flatten(F.transform(F.array_distinct(F.transform("features", lambda x: x.path)), lambda p: F.transform(depth(p), lambda q: F.xxhash64(q))))
    pages = slim.select("host", F.explode(F.array_distinct(met)).alias("node")).groupBy("host", "node").agg(F.count("*").alias("pages"))
    own_pages = slim.select("host", F.explode(F.array_distinct(F.transform("features", lambda x: x.path))).alias("path")).groupBy("host", "path").agg(F.count("*").alias("pages"))
    # H of a feature seen once on each of n of m pages is log n / log m.
    leaf = (
        spread.groupBy("host", "path").agg(F.avg(F.log2("n")).alias("spread"), F.count("*").alias("features"))
        .join(own_pages, ["host", "path"])
        .withColumn("own", F.when(F.col("pages") > 1, 1 - F.col("spread") / F.log2("pages")).otherwise(F.lit(1.0)))
    )
    # A branch's importance is the mean of the leaves below it, each as often as pages have it.
    below = (
        leaf.select("host", F.explode(depth(F.col("path"))).alias("path"), "own", "features", F.col("pages").alias("weight"))
        .groupBy("host", "path").agg((F.sum(F.col("own") * F.col("weight")) / F.sum("weight")).alias("below"), F.sum(F.col("own") * F.col("features")).alias("varied"))
        .withColumn("node", F.xxhash64("path"))
    )
    shown = slim.select("host", F.explode("styles").alias("x")).select("host", "x.path", "x.style").groupBy("host", "path", "style").agg(F.count("*").alias("n"))
    shape = shown.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    shape = shape.select("host", "path", F.when(F.col("m") > 1, (F.log2("m") - F.col("nlogn") / F.col("m")) / F.log2("m")).otherwise(F.lit(1.0)).alias("shape"))
    return (
        below.join(pages, ["host", "node"]).join(shape, ["host", "path"], "left")
        .select("host", "path", "pages", "varied", (F.col("below") * (1 - OWN_WEIGHT) + F.coalesce("shape", "below") * OWN_WEIGHT).alias("importance"))
    )


def extract_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """``page_id, url, text`` per row of ``pages`` (``page_id, url, html``; other columns are ignored).

    Elements that HTML or their names mark as template parts hold no content;
    if an article or main element is left, only text inside one counts. Each
    branch with importance below ``least`` on at least ``least_pages`` distinct
    pages of its host is removed, inside an article too, unless it holds most of
    what varies on the host. An article that would lose most of its characters
    so is a near copy of others, which share its text, and stays whole. Blocks keep
    page order, joined by \\n. Null or empty html, or a page of template parts
    only, gives an empty text; a page without url or host belongs to the host
    ''. Repeated rows give repeated results.
    """
    trees = stored(page_trees(pages), "page-trees")
    tree = style_tree(trees)
    below = lambda path, branch: (branch != "") & F.startswith(path, F.concat(branch, F.lit(">")))
    found = tree.filter((F.col("path") == WHOLE) | (F.col("pages") >= least_pages) & (F.col("importance") < least))
    listed = found.groupBy("host").agg(
        F.collect_list(F.when(F.col("path") != WHOLE, F.struct("path", "varied"))).alias("low"), F.max(F.when(F.col("path") == WHOLE, F.col("varied"))).alias("all")
    )
    # What varies most is no template; of the others only the topmost are needed.
    few = F.transform(F.filter("low", lambda x: (x.varied == 0) | (x.varied < F.col("all") * MOST_VARIED)), lambda x: x.path)
    top = F.filter("noise", lambda p: ~F.exists("noise", lambda q: below(p, q)))
    noise = listed.select("host", few.alias("noise")).select("host", top.alias("noise")).filter(F.size("noise") > 0)
    # A list per host is as long as its template has parts, not as its pages; many hosts' lists meet their pages in a join.
    noise = broadcast_if_small(stored(noise, "template-parts"), HOSTS)
    counted = F.when(F.exists("blocks", lambda b: b.inside), F.filter("blocks", lambda b: b.inside))
    chars = lambda blocks: F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.length(b.text))
    left = lambda blocks: F.filter(blocks, lambda b: ~F.exists("noise", lambda p: (b.path == p) | below(b.path, p)))
    judged = let(counted, lambda inside: F.when(inside.isNull(), left(F.col("blocks"))).otherwise(
        let(left(inside), lambda some: F.when(chars(some) >= chars(inside) * LEAST_LEFT, some).otherwise(inside))
    ))
    body = F.when(F.col("noise").isNull(), F.coalesce(counted, "blocks")).otherwise(judged)
    text = F.array_join(F.transform(body, lambda b: b.text), "\n")
    return trees.drop("styles").join(noise, "host", "left").select("page_id", "url", text.alias("text"))
