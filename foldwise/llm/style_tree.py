"""Main text of pages by site style trees.

The DOMs of a host's pages are merged: an element node is a path of tag names with
class and id, and its style nodes are the sequences of children that pages show there
(repeats next to each other count once).  With m pages at a node:

* presentation: the entropy, to base m, of the shares of its styles (m = 1: 1);
* content (the node's own text): 1 less the mean entropy of its features -- runs of
  text, with digits alike, and link targets -- where a feature on k pages has log_m k;
* the importance of a node with s styles is (1 - g^s) presentation + g^s mean
  importance, weighted by share, of its styles; that of a style is the mean of its
  children, the own text being one of them.

Beside its importance a node carries the highest content importance below it (``best``).  A page's
branch is removed where its importance is below ``threshold`` and nothing below it reaches
``unique``: a low mean over constant siblings, or a fade over wrappers, takes no text of its own with it.
What is noise on any site by its meaning (navigation, forms, adverts, comments, ...) goes anyway.
The landmarks ``article`` and ``main`` are never removed, and the tree decides nothing within them:
what an article says on many pages is article all the same.  Where a page has a landmark with text,
branches that neither hold it nor lie in it go.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm import dom
from foldwise.llm.common import materialize, row_key

#: Elements that are noise wherever they stand.
NOISE_TAGS = frozenset("""aside button canvas dialog embed fieldset footer form head iframe input label menu nav noscript
    object optgroup option script search select style svg template textarea title""".split())
#: Words of class, id or role that name noise.
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
    cookie cookies consent gdpr notice notification alert popup modal overlay dialog newsletter subscribe signup login
    sidebar aside complementary widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer
    contentinfo header masthead topbar toolbar search share sharing social related recommended comment comments disqus
    respond reply replies discussion form""".split())
#: Beginnings of words that name noise too ("commentlist", "adverts2").
NOISE_STEMS = ("advert", "comment", "cookie", "newsletter", "sidebar")
#: Words that name a title within a landmark, and noise elsewhere.
TITLE_WORDS = frozenset(("header", "masthead"))
#: Noise words that also name parts of a text ("related-work", "form-factor").  Within a landmark they name noise
#: only where at least ``LINKED`` of the text is links, or where "related" is all that is said.
AMBIGUOUS = frozenset("alert discussion form notice related search share social".split())
LINKED = 0.5
LANDMARKS = frozenset(("article", "main"))
COMMENT_WORDS = frozenset(("comment", "comments", "reply", "replies", "respond", "disqus", "discussion"))
OWN_TEXT = "#text"


def _hash(text: str) -> int:
    """XXH64 as a signed integer."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@functools.lru_cache(maxsize=1 << 16)
def node_id(host: str, path: str) -> int:
    return _hash(f"{host}\0{path}")


def _named_noise(e: dom.Element, inside: bool, linked: float) -> bool:
    if e.tag in ("html", "body"):
        return False
    named = e.words & (COMMENT_WORDS if e.tag in LANDMARKS else NOISE_WORDS - (TITLE_WORDS if inside else frozenset()))
    if inside and named <= AMBIGUOUS and e.words != {"related"} and linked < LINKED:
        named = frozenset()
    return bool(named) or e.tag not in LANDMARKS and any(w.startswith(NOISE_STEMS) for w in e.words)


def _linked(page: dom.Page) -> np.ndarray:
    """Share of links in the text of each element."""
    n = len(page.elements)
    link, chars = np.zeros(n, bool), np.zeros((2, n))
    for i, e in enumerate(page.elements):
        link[i] = i > 0 and link[e.parent] or e.tag == "a"
    for r in page.runs:
        chars[:, r.owner] += len(r.text.strip()) * np.array([1, link[r.owner]])
    for i in range(n - 1, 0, -1):
        chars[:, page.elements[i].parent] += chars[:, i]
    return chars[1] / np.maximum(chars[0], 1)


def noise_by_meaning(page: dom.Page) -> tuple[np.ndarray, np.ndarray]:
    """(noise, kept) by element: noise by meaning; landmarks, what they hold and what holds them."""
    n = len(page.elements)
    text, foreign, inside = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    for r in page.runs:
        if r.text and not r.text.isspace():
            text[r.owner] = True
    for i in range(n - 1, 0, -1):
        text[page.elements[i].parent] |= text[i]
    landmark = np.array([e.tag in LANDMARKS or "main" in e.words and e.tag not in ("html", "body") for e in page.elements])
    for i, e in enumerate(page.elements):
        up = e.parent if i else 0
        foreign[i] = foreign[up] or e.tag in ("aside", "nav", "footer") or (i > 0 and bool(e.words & COMMENT_WORDS) and e.tag not in ("html", "body"))
        inside[i] = inside[up] or (landmark[i] and text[i] and not foreign[i])
    guarded = np.zeros(n, bool)  # the outermost landmarks, and what holds them
    for i, e in enumerate(page.elements):
        if inside[i] and not inside[e.parent]:
            guarded[i] = True
            while i > 0 and not guarded[page.elements[i].parent]:
                i = page.elements[i].parent
                guarded[i] = True
    noise, marked = np.zeros(n, bool), inside.any()
    linked = _linked(page) if any(inside[i] and e.words & AMBIGUOUS for i, e in enumerate(page.elements)) else np.zeros(n)
    for i, e in enumerate(page.elements):
        if i == 0 or guarded[i]:
            continue
        noise[i] = noise[e.parent] or e.tag in NOISE_TAGS or e.tag == "header" and not inside[i] or _named_noise(e, inside[i], linked[i])
    return noise | (marked & ~inside), guarded | inside


def main_text(source: str | None, low, host: str) -> str:
    """The text of a page without its noise; ``low`` tells which of some node ids are branches to remove.

    If that would leave nothing of a page that has text apart from noise by meaning, only the latter
    is removed."""
    if not source:
        return ""
    page = dom.parse(source)
    noise, kept = noise_by_meaning(page)
    cut = removed(page, low, host, kept)

    def render(gone: np.ndarray) -> str:
        blocks: list[str] = []
        last, parts = None, []
        for r in page.runs:
            if not r.text or gone[r.owner]:
                continue
            if r.block != last:
                blocks.append("".join(parts))
                last, parts = r.block, []
            parts.append(r.text)
        blocks.append("".join(parts))
        return "\n".join(b for b in map(dom.squeeze, blocks) if b)

    return (render(noise | cut) if cut.any() else "") or render(noise)


def removed(page: dom.Page, low, host: str, kept: np.ndarray) -> np.ndarray:
    """Whether the tree removes each element, with the branch that it lies in."""
    found = np.asarray(low([node_id(host, e.path) for e in page.elements]), bool) & ~kept
    found[0] = False
    if found.any():
        for i, e in enumerate(page.elements):
            found[i] = found[i] or i > 0 and found[e.parent] and not kept[i]
    return found


def features(source: str, host: str) -> tuple[dict, set]:
    """({node id: (parent id, depth)}, {(node id, kind, value)}) of a page: kind 0 is the node's
    presence, 1 a style, 2 a feature of its own text."""
    page = dom.parse(source)
    ids = [node_id(host, e.path) for e in page.elements]
    nodes, seen = {}, set()
    texts = set()
    for r in page.runs:
        what = r.link if r.link is not None else dom.squeeze(r.text)
        if what:
            me = node_id(host, f"{page.elements[r.owner].path}/{OWN_TEXT}")
            nodes[me] = (ids[r.owner], page.elements[r.owner].depth + 1)
            seen.add((me, 0, 0))
            seen.add((me, 2, _hash(re.sub(r"\d+", "9", what.lower()))))
            texts.add(r.owner)
    for i, e in enumerate(page.elements):
        if i and ids[i] == ids[e.parent]:
            continue
        nodes[ids[i]] = (ids[e.parent] if i else 0, e.depth)
        seen.add((ids[i], 0, 0))
        names = [c for c in e.children] + ([OWN_TEXT] if i in texts else [])
        if names:
            style = _hash("\0".join(names))
            seen.add((ids[i], 1, style))
            for c in {node_id(host, f"{e.path}/{c}") for c in names}:
                seen.add((c, 3, style))  # a child of that style of its parent
    return nodes, seen


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame, gamma: float = 0.9, min_pages: int = 5) -> DataFrame:
    """(node, importance, best) of the merged trees of all hosts; pages have columns host and html.

    Counts are summed within tasks, then by Spark, so a large host's pages do not meet in
    one task.  Importances go up the tree by one join and one aggregation per level, at
    most ``dom.MAX_DEPTH`` + 2.  Nodes on fewer than ``min_pages`` pages have importance 1."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "parent")] + [T.StructField("depth", T.IntegerType()),
                          T.StructField("kind", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("value", "n")])

    def count(batches):
        sums, place = Counter(), {}

        def batch():
            rows = [(node, *place[node], kind, value, n) for (node, kind, value), n in sums.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if f.name in ("depth", "kind") else pa.int64())
                                               for c, f in zip(zip(*rows), schema)], names=schema.names)

        for b in batches:
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if source:
                    nodes, seen = features(source, host)
                    place.update(nodes)
                    sums.update(x for x in seen if x[0] in place)
                    if len(sums) > 200_000:
                        yield batch()
                        sums, place = Counter(), {}
        if sums:
            yield batch()

    counts = (pages.select("host", "html").mapInArrow(count, schema).groupBy("node", "kind", "value")
              .agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n").alias("n")))
    counts = materialize(counts)
    m = counts.where("kind = 0").select("node", "parent", "depth", F.col("n").alias("m"))
    log_m = F.log(F.col("m").cast("double"))
    own = (counts.where("kind = 2").groupBy("node").agg(F.sum(F.log(F.col("n").cast("double"))).alias("h"), F.count(F.lit(1)).alias("l")))
    share = F.col("n") / F.col("total")
    styles = counts.where("kind = 1").select("node", "value", "n")
    total = styles.groupBy("node").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("s"))
    shown = styles.join(total, "node").groupBy("node", "s").agg(F.sum(-share * F.log(share)).alias("p"))
    nodes = (m.join(own, "node", "left").join(shown, "node", "left")
             .select("node", "parent", "depth", "m",
                     F.when(F.col("h").isNotNull(), F.when(F.col("m") > 1, 1 - F.least(F.col("h") / (F.col("l") * log_m), F.lit(1.0)))
                            .otherwise(1.0)).alias("content"),
                     F.when(F.col("m") > 1, F.least(F.col("p") / log_m, F.lit(1.0))).otherwise(1.0).alias("shown"),
                     F.coalesce("s", F.lit(0)).alias("s")))
    nodes = materialize(nodes)
    members = materialize(counts.where("kind = 3").select("node", "parent", F.col("value").alias("style")))
    weights = styles.join(total, "node").select(F.col("node").alias("parent"), F.col("value").alias("style"), share.alias("share"))
    weights = materialize(weights)
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("node", F.lit(1.0).alias("importance"), F.lit(1.0).alias("best"))
    done = None
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if done is None:
            level = level.withColumn("below", F.lit(None).cast("double")).withColumn("top", F.lit(None).cast("double"))
        else:
            styled = (members.join(done, "node").groupBy("parent", "style").agg(F.avg("importance").alias("i"), F.max("best").alias("b"))
                      .join(weights, ["parent", "style"]).groupBy("parent")
                      .agg(F.sum(F.col("share") * F.col("i")).alias("below"), F.max("b").alias("top")))
            level = level.join(styled.withColumnRenamed("parent", "node"), "node", "left")
        fade = F.pow(F.lit(gamma), F.col("s"))
        mixed = (1 - fade) * F.col("shown") + fade * F.col("below")
        value = F.coalesce("content", mixed, F.lit(1.0))
        level = materialize(level.select("node", "m", value.alias("importance"), F.coalesce("content", "top", F.lit(0.0)).alias("best")))
        out = level if done is None else out.unionByName(level)
        done = level.select("node", "importance", "best")
    return out.select("node", *[F.when(F.col("m") >= min_pages, F.col(c)).otherwise(1.0).alias(c) for c in ("importance", "best")])


def low_branches(tree: DataFrame, threshold: float, unique: float) -> DataFrame:
    """(node): nodes whose branch is removed."""
    return tree.where((F.col("importance") < threshold) & (F.col("best") < unique)).select("node")


def members_of(nodes: np.ndarray):
    """Which of some node ids are in a sorted array of 8 bytes each."""
    def low(ids: list[int]) -> np.ndarray:
        ids = np.array(ids, np.int64)
        if not len(nodes):
            return np.zeros(len(ids), bool)
        return nodes[np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)] == ids
    return low


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.3,
            unique: float = 0.5, gamma: float = 0.9, min_pages: int = 5, broadcast_nodes: int = 1_000_000) -> DataFrame:
    """Main text of each page: (id, url, text, n_chars).

    One row per input row.  A null or empty html, or one without text, gives ''.  A null
    url is a host of its own.  Blocks are joined by one newline; white space within a block is one space;
    ``n_chars`` counts code points.  A node exactly at ``threshold`` or ``unique`` stays; text that repeats
    within an article stays.  Up to ``broadcast_nodes`` nodes to remove (counted first, 8 bytes each in
    the array that is sent) are broadcast; beyond it each page gets those among its own nodes
    by a join."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    low = materialize(low_branches(style_tree(rows, gamma, min_pages), threshold, unique))
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = None
    if low.count() <= broadcast_nodes:
        shared = rows.sparkSession.sparkContext.broadcast(np.sort(low.toArrow()["node"].to_numpy()))
        rows = rows.select("id", "url", "host", "html", F.lit(None).cast("array<bigint>").alias("low"))
    else:
        key = row_key(F.col("id"), F.concat_ws("\x1f", "url", "html"))
        node = T.StructType([T.StructField("k", T.StringType()), T.StructField("node", T.LongType())])

        def own(batches):
            for b in batches:
                ks, nodes = [], []
                for k, host, source in zip(*(c.to_pylist() for c in b.columns)):
                    mine = features(source, host)[0] if source else {}
                    ks += [k] * len(mine)
                    nodes += mine
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(nodes, pa.int64())], names=["k", "node"])

        rows = rows.withColumn("k", key)
        mine = (rows.select("k", "host", "html").mapInArrow(own, node).join(low, "node").groupBy("k").agg(F.collect_set("node").alias("low")))
        rows = rows.join(mine, "k", "left").select("id", "url", "host", "html", "low")

    def texts(batches):
        common = members_of(shared.value if shared else np.empty(0, np.int64))
        for b in batches:
            out = []
            for host, source, own in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                known = common if own is None else members_of(np.sort(np.array(own, np.int64)))
                out.append(main_text(source, known, host))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()),
                                              pa.array(list(map(len, out)), pa.int64())], names=schema.names)

    return rows.mapInArrow(texts, schema).withColumnsRenamed({"id": id_col, "url": url_col})
