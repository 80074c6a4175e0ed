import re

import pytest

from loomstone.llm import html


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>a  b\n c</p>", "a b c"), ("<p>a<br>b</p>", "a b"),
        ("<p>1 &lt; 2 &amp 3 &#233; &nbsp;x</p>", "1 < 2 & 3 é x"), ("a < b and c > d", "a < b and c > d"),
        ("<html><head><title>t</title></head><body><nav>n</nav><article><h1>T</h1><p><b>x</b>y</p></article><footer>f</footer>", "T\nxy"),
        ("<article><p>a</p><div class='comments'><p>no</p></div><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><script>if (a<b) '</p>'</script><style>p{}</style><form><p>f</p></form><aside>s</aside></article>", "a"),
        ("<main><p>m</p></main><p>outside</p>", "m"), ("<div id=sidebar>s</div><div><p>d</p></div>", "d"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"), ("<p>cut <b>off</b> <a hre", "cut off"), ("<p>a<!-- c --><!-- open", "a"),
        ("<DIV CLASS='Ad'>x</DIV><P>y</P>", "y"), ("<p>a</div></p></article>b", "a\nb"), ("<div hidden>h</div><div role=navigation>r</div><p>v</p>", "v"),
        ("<div class='page has-sidebar'><article><div class='article-header'><h1>T</h1></div><p>a</p></article><div class=sidebar>s</div></div>", "T\na"),
        ("<div class='page sidebar'><article><p>a</p></article></div>", "a"), ("<div class=header>h</div><p>a</p>", "a"),
        ("<article><header><h1>T</h1></header><p>a</p></article>", "T\na"), ("<p>x</p>" * 3, "x\nx\nx"),
    ],
)
def test_extract(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>0</p><section id='discussion'><h2 id='how-to-register'>H</h2><p>a</p></section><section id=related-work><p>b</p></section></article>", "0\nH\na\nb"),
        ("<article><p class='search reply'>a</p><div class='sponsored'>no</div></article>", "a"),
        ("<article><figure><img><figcaption>c</figcaption></figure><p>x <math><mi>y</mi></math></p><p><object>z</object></p></article>", "c\nx y\nz"),
        ("<main><h1>Title</h1><p>Long main text here.</p><article><p>teaser</p></article></main><p>out</p>", "Title\nLong main text here.\nteaser"),
        ("<p>out</p><article><p>one</p></article><article><p>two</p><article class='comment'><p>reader</p></article></article>", "one\ntwo"),
        ("<p>E = <math>mc2</math></p>", "E = mc2"), ("<p>a<svg><p>b", "a\nb"), ("<p>a<select><p>b", "a\nb"), ("<p>a<math><p>b", "a\nb"), ("<p>a<script>b<p>c", "a"), ("<p>a<svg><text>s</text></svg>b", "a b"),
    ],
)
def test_articles_keep_their_text(page, text):
    assert html.extract(page) == text


def test_deep_and_long_pages():
    assert html.extract("<div>" * 20_000 + "deep") == "deep"
    assert html.extract("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert html.extract("<" * 5000) is not None and html.extract('<a href="' + "x" * 100_000) == ""


def test_digests_tell_subtrees():
    one = html.parse("<div><p>a</p></div>")[1]
    assert one == html.parse("<section>x</section><div class=k><p>a</p></div>")[1][1:] != html.parse("<div><p>b</p></div>")[1]


def test_templates(spark):
    rows = [(i, f"http://h/{i}", f"<div><p>own {i}</p></div><div><ul><li>menu</li></ul></div>") for i in range(6)]
    rows += [(10 + i, f"http://few/{i}", f"<div><p>own {i}</p></div><div><p>seen twice</p></div>") for i in range(2)]
    rows += [(20 + i, f"http://copies/{i}", "<div><p>a copied page</p></div>") for i in range(9)]
    rows += [(30, None, "<p>no host</p>"), (31, "not a url", None), (0, "http://h/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, page int, text int").repartition(3)
    got = html.extracted(pages).collect()
    assert len(got) == len(rows)
    texts = {g["page_id"]: g["text"] for g in got}
    assert texts[0] == "own 0" and texts[5] == "own 5" and texts[10] == "own 0\nseen twice" and texts[20] == "a copied page" and texts[30] == "no host" and texts[31] == ""
    assert html.extracted(pages.filter("false")).isEmpty()


def test_templates_inside_articles(spark):
    """Boilerplate of single blocks under article, main or body goes; what a host's pages have of their own stays."""
    rows = [(i, f"http://a/{i}", f"<body><article><h2>Our story</h2><p>own text {i} of a page</p><p>Read us daily</p></article>") for i in range(8)]
    rows += [(10 + i, f"http://b/{i}", f"<body><p>own text {i} of a page</p><p>All rights reserved</p>") for i in range(8)]
    got = {g["page_id"]: g["text"] for g in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own text {i % 10} of a page" for i in got} and len(got) == 16


def test_what_isnt_template(spark):
    """The same article on pages that differ around it or in a line, and what few of a host's many pages share, stay."""
    body = "<article><div class='entry-content'><p>An article that a host shows more than once.</p><p>And its end.</p></div>{}</article>"
    rows = [(i, f"http://around/{i}", body.format("") + f"<p>menu {i}</p>") for i in range(7)]
    rows += [(10 + i, f"http://line/{i}", body.format(f"<p>{i}</p>")) for i in range(7)]
    rows += [(100 + i, f"http://many/{i}", f"<article><p>own text {i}</p>{'<blockquote>a quotation</blockquote>' if i < 5 else ''}</article>") for i in range(60)]
    got = {g["page_id"]: g["text"] for g in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "An article that a host shows more than once.\nAnd its end."
    assert all(got[i] == whole and got[10 + i] == f"{whole}\n{i}" for i in range(7))
    assert all(got[100 + i] == f"own text {i}" + ("\na quotation" if i < 5 else "") for i in range(60))


def brute(pages):
    """Text of each page by the rule told plainly, with plain dictionaries."""
    found = []
    for page_id, url, page in pages:
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        blocks, digests, parents = html.parse(page or "")
        found.append((page_id, m[1].lower() if m else "", page or "", tuple(b[0] for b in html.best(blocks)), {digests[c] for c in html.with_text(blocks, parents)}))
    contents, holders = {}, {}
    for _, h, _, content, own in found:
        contents.setdefault(h, set()).add(content)
        for d in own:
            holders.setdefault((h, d), set()).add(content)
    out = []
    for page_id, h, page, _, own in found:
        template = {d for d in own if len(holders[h, d]) >= 5 and len(holders[h, d]) >= 0.25 * len(contents[h])}
        out.append((page_id, html.extract(page, frozenset(d - (1 << 63) for d in template))))
    return sorted(out, key=str)


def test_query(spark, sf_dir, tmp_path, monkeypatch):
    """The registered query over the table, and over pages whose result the count of elements changes."""
    from loomstone.llm.queries import QUERIES

    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = QUERIES["op8_html_extract"](spark, sf_dir).collect()
    assert sorted(((r["page_id"], r["text"]) for r in rows), key=str) == brute(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    framed = [(i, u, h.replace("<article>", "<article><p>Read us daily.</p><ul><li>One</li></ul>").replace("</article>", "<div><p>All the best from the editors</p></div></article>")) for i, u, h in pages]
    framed = [(i, "http://one.example/" if i % 3 else u, h) for i, u, h in framed] + [(None, None, None), framed[0], (-1, "http://one.example/x", "")]
    spark.createDataFrame(framed, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["text"]) for r in QUERIES["op8_html_extract"](spark, str(tmp_path)).collect()), key=str)
    assert got == brute(framed)
    own = {i: html.extract(h) for i, _, h in pages}
    cut = {i: t for i, t in got if i is not None and i >= 0 and i % 3}
    assert cut and all(cut[i] == own[i] for i in cut)
    monkeypatch.setattr(html, "SHARE", 2.0)
    assert all("Read us daily." in r["text"] for r in html.extracted(spark.read.parquet(f"{tmp_path}/pages.parquet"), 10**9).collect() if r["page_id"] in cut)
