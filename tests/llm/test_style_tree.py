import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from foldwise.llm import dom
from foldwise.llm import style_tree as st


def text(source):
    return st.main_text(source, st.members_of(np.empty(0, np.int64)), "h")


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("   ", ""), ("plain  text &amp; more &am", "plain text & more &am"), ("a < b > c <p", "a < b > c"),
    ("<p>one<p>two<br>three<b>four</b>", "one\ntwo threefour"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
    ("<!-- x <p>no --><p>y<!-- never closed <p>z", "y"),
    ("<script>if (a<b) '</p>'</script><p>x</p><style>p{}</style><textarea><p>t</textarea>", "x"),
    ("<body><header>T</header><nav>n</nav><div class='ad-top'>ad</div><p>real</p><footer>f</footer>", "real"),
    ("<body>out<main><article><h1>T</h1><p>A</p><aside>s</aside><div class=related>r</div></article><section id=comments><article>c</article>"
     "</section></main><div>more</div>", "T\nA"),
    ("<article class='comment'>c</article><p>x</p>", "x"),
    ("<form><input value=v><button>b</button></form><p>x", "x"),
    ("<p title='a>b'>q</p><p title=\"x>y\">r", "q\nr"),
    ("<P>&#233;&eacute;&lt;p&gt;&nbsp;z</P>", "éé<p> z"),
    ("<div class='page has-sidebar'><p>kept</p><ol class=commentlist><li>c</ol></div>", "kept"),
    ("<article><div class='post-header'><h2>T</h2></div><p>A</p></article>", "T\nA"),
    ("<div class='site-header'>S</div><p>A</p>", "A"),
    ("<div>tail<div>in</div>after</div>", "tail\nin\nafter"),
])
def test_main_text(source, want):
    assert text(source) == want


def pages():
    rows = []
    for i in range(12):
        body = "".join(f"<p>page {chr(97 + i)} paragraph {'x' * j} of its own {chr(97 + i) * 3}</p>" for j in range(1, 3 + i % 2))
        rows.append((i, f"http://Site.example.com/{i}", f"<html><body><div class='top{i}'><a href='/home'>Home</a><a href='/x'>News</a></div>"
                     f"<div class='text'>{body}</div><div class='bottom'>All rights held {i}</div></body></html>"))
    rows += [(20, "http://lonely.org/", "<div class='bottom'>All rights held 1</div>"), (21, None, "<p>no host</p>"), (22, "http://x.org", None),
             (23, "http://x.org/", ""), (None, "http://x.org/a", "<p>null id</p>"), (30, "http://x.org/b", "<p>again</p>"), (30, "http://x.org/b", "<p>again</p>"),
             (24, "http://long.org", "<div>" * 3000 + "deep" + "<p>" + "w " * 50_000)]
    return rows


SCHEMA = "page_id long, url string, html string"


def slow_importance(rows, gamma, least):
    """(importance, best): the definitions, on dictionaries, for one host."""
    m, parent, depth, kinds = Counter(), {}, {}, defaultdict(Counter)
    for _, _, source in rows:
        nodes, seen = st.features(source, "site.example.com")
        for n, (p, d) in nodes.items():
            parent[n], depth[n] = p, d
        for n, kind, value in seen:
            kinds[kind, n][value] += 1
            if kind == 0:
                m[n] += 1
    out, best = {}, {}
    for n in sorted(m, key=lambda n: -depth[n]):
        styles, own = kinds[1, n], kinds[2, n]
        best[n] = max((best[c] for c in m if parent[c] == n and n != c), default=0.0)
        if own:
            best[n] = out[n] = 1 - sum(math.log(k) for k in own.values()) / (len(own) * math.log(m[n])) if m[n] > 1 else 1.0
            continue
        if not styles:
            out[n] = 1.0
            continue
        total = sum(styles.values())
        shown = -sum(v / total * math.log(v / total) for v in styles.values()) / math.log(m[n]) if m[n] > 1 else 1.0
        below = 0
        for style, v in styles.items():
            kids = [out[c] for c in m if parent[c] == n and kinds[3, c][style]]
            below += v / total * sum(kids) / len(kids)
        fade = gamma ** len(styles)
        out[n] = (1 - fade) * min(shown, 1) + fade * below
    return {n: (out[n], best[n]) if m[n] >= least else (1.0, 1.0) for n in out}


def test_importance_against_brute_force(spark):
    rows = [r for r in pages() if r[0] is not None and r[0] < 12]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", st.host_of("url"))
    for gamma in (0.9, 0.3):
        got = {r.node: (r.importance, r.best) for r in st.style_tree(df, gamma).collect()}
        want = slow_importance(rows, gamma, 5)
        assert got.keys() == want.keys()
        assert all(np.allclose(got[n], want[n], atol=1e-9) for n in got)


def site(kind):
    """A documented site of 20 pages without landmarks: a constant bar of links, a line that differs on one page in
    four, a promo with one word of its own per page, unique paragraphs, a constant footer."""
    rows = []
    for i in range(20):
        c = chr(97 + i)
        main = f"<p>story {c * 3} begins</p><p>and goes on {c * 4}</p>"
        if kind == "article":
            main = f"<article><h2>Method</h2>{main}<p>Read on.</p></article>"
        rows.append((i, f"http://site.example.com/{i}", f"<html><body><div class=bar><a href=/a>A</a><a href=/b>B</a></div><div class=line>mood {'abcd'[i % 4] * 3}</div>"
                     f"<div class=promo><span>Buy now</span><span class=own>{c * 2}</span></div><div class=story>{main}</div><div class=end><i>All rights</i> held</div></body></html>"))
    return rows


def slow_text(rows, threshold, unique, gamma):
    """Texts by walking each page's own tree from the top; and how many branches go."""
    table, texts, gone = slow_importance(rows, gamma, 5), [], 0
    for _, _, source in rows:
        page = dom.parse(source)
        noise, kept = st.noise_by_meaning(page)
        cut = []
        for i, e in enumerate(page.elements):
            importance, best = table[st.node_id("site.example.com", e.path)]
            mine = i > 0 and not kept[i] and importance < threshold and best < unique
            gone += bool(mine and not cut[e.parent])
            cut.append(mine or bool(i and cut[e.parent] and not kept[i]))
        blocks = {}
        for r in page.runs:
            if not cut[r.owner] and not noise[r.owner]:
                blocks.setdefault(r.block, []).append(r.text)
        texts.append("\n".join(t for t in (dom.squeeze("".join(b)) for b in blocks.values()) if t))
    return texts, gone


@pytest.mark.parametrize("kind", ["plain", "article"])
@pytest.mark.parametrize("options", [{}, {"gamma": 0.99}, {"threshold": 0.1}, {"threshold": 0.9, "unique": 0.9}])
def test_text_against_brute_force(spark, kind, options):
    rows = site(kind)
    got = [r.text for r in st.extract(spark.createDataFrame(rows, SCHEMA), **options).orderBy("page_id").collect()]
    want, gone = slow_text(rows, options.get("threshold", 0.3), options.get("unique", 0.5), options.get("gamma", 0.9))
    assert got == want and gone >= 20
    c = "ccc"
    assert f"story {c} begins" in got[2] and "All rights" not in got[2]
    if kind == "article":  # what repeats within an article stays
        assert got[2] == f"Method\nstory {c} begins\nand goes on cccc\nRead on."


def test_every_parameter_decides(spark):
    """The threshold, the fade and the guard each change the texts of a site."""
    df = spark.createDataFrame(site("plain"), SCHEMA)

    def texts(**options):
        return [r.text for r in st.extract(df, **options).orderBy("page_id").collect()]

    usual = texts()
    assert "mood" in usual[0] and texts(threshold=0.0) != usual
    faded = texts(gamma=0.2)  # the mood line's importance is 0.46 of its own, and fades
    assert "mood" not in faded[0] and "story" in faded[0]
    assert texts(gamma=0.2, unique=0.4) == usual  # below the guard it stays


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_extract(spark, limit):
    rows = pages()
    df = spark.createDataFrame([(*r, "h", 1, 2) for r in rows], SCHEMA + ", host string, low int, k int")
    got = st.extract(df, broadcast_nodes=limit).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i in range(12):
        assert "paragraph x of its own" in by[i] and "All rights" not in by[i] and "Home" not in by[i], by[i]
    assert by[20] == "All rights held 1" and by[21] == "no host" and by[22] == by[23] == "" and by[None] == "null id"
    assert by[24].split("\n")[0] == "deep" and len(by[24]) == 4 + 1 + 99_999
    assert st.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_keep_their_text(spark):
    page = "<html><body><nav>m</nav><article><h1>T</h1><p>the same article</p></article></body></html>"
    rows = [(i, f"http://copy.org/{i}", page) for i in range(30)]
    assert {r.text for r in st.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"T\nthe same article"}


def test_depth_is_bounded():
    assert max(e.depth for e in dom.parse("<div>" * 500 + "x").elements) == dom.MAX_DEPTH


def test_unique_text_survives_low_means(spark):
    """Constant siblings in an article, and more wrappers than the fade bears, take no unique text with them."""
    def page(i, body):
        return f"<html><body><div class=top><a href=/>Home</a></div>{body}<div class=bottom>All rights held</div></body></html>"

    entry = [f"<article><h1>Title {c}</h1><div class=entry><p>first of {c}</p><p>second of {c * 2}</p><span class=byline>By the staff</span>"
             "<ul class=tags><li>news</li></ul><div class=offer>Buy now</div></div></article>" for c in "abcdefgh"]
    deep = ["<div class=w>" * 14 + f"<p>deep words of {c}</p>" + "</div>" * 14 for c in "abcdefgh"]
    rows = [(i, f"http://entry.org/{i}", page(i, b)) for i, b in enumerate(entry)]
    rows += [(100 + i, f"http://deep.org/{i}", page(i, b)) for i, b in enumerate(deep)]
    got = {r.page_id: r.text for r in st.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, c in enumerate("abcdefgh"):
        assert got[i] == f"Title {c}\nfirst of {c}\nsecond of {c * 2}\nBy the staff\nnews\nBuy now"
        assert got[100 + i] == f"deep words of {c}"


@pytest.mark.parametrize("part,want", [
    ("<section id='discussion'><p>We discuss it.</p></section>", "A\nWe discuss it."), ("<div class='related-work'><p>Others <a href=/x>did</a> so.</p></div>", "A\nOthers did so."),
    ("<div id='form-factor'>small</div><p class='share-price'>12</p><div class='search-results'>three</div>", "A\nsmall\n12\nthree"),
    ("<div class='share'><a href=/x>Tweet</a> <a href=/y>Mail</a></div>", "A"), ("<div class='related-posts'><a href=/x>More</a></div>", "A"),
    ("<section id='comments'><p>first!</p></section>", "A"), ("<div class='social newsletter'>Sign up</div>", "A"),
])
def test_ambiguous_names_in_an_article(part, want):
    assert text(f"<body><article><p>A</p>{part}</article><div class=notice>n</div></body>") == want
