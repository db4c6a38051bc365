"""Main text extraction: hand-made pages, the minimum cut against all labellings, the query."""
import html
import itertools
import random
import re

import pytest

from stancekit.llm import common as C
from stancekit.llm import html_extract as H
from stancekit.llm import queries as Q

A = "The first paragraph of the article says something of some length, as paragraphs do."
B = "A second one follows, and it goes on for a while before it comes to its end."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li></ul>'
SHELLS = {
    "article": "<html><head><title>T</title></head><body><nav>{menu}</nav><article><h1>Title</h1><p>{a}</p><p>{b}</p></article><footer>&copy; 2020 Us</footer></body></html>",
    "main": "<body><header><a href='/'>Site</a> The daily site</header><main><h1>Title</h1><p>{a}</p><p>{b}</p></main><aside><h2>More</h2><p>Another story that is not this one, with a text of some length.</p></aside></body>",
    "divs": '<body><div id="menu">{menu}</div><div class="post-content"><h1>Title</h1><p>{a}</p><p>{b}</p></div><div class="sidebar"><p>Read also what others have to say on quite other matters today.</p></div><div id="footer">All rights reserved by the people who own this site.</div></body>',
    "plain": "<body><h1>Title</h1><p>{a}</p><p>{b}</p></body>",
    "cookie": '<body><div class="cookie-notice"><p>We use cookies to make this site work and to learn how it is used. Accept them all?</p><button>OK</button></div><article><h1>Title</h1><p>{a}</p><div class="ad-banner">Buy our very good things now, they are cheap today.</div><p>{b}</p></article></body>',
    "comments": '<body><article><h1>Title</h1><p>{a}</p><p>{b}</p><section class="comments"><h3>Comments</h3><p>I read this with joy and wish to say so at some length here.</p><form><textarea>x</textarea><input type=submit></form></section></article></body>',
    "hidden": '<body><article><h1>Title</h1><p>{a}</p><p style="display:none">You should never see this paragraph on any screen.</p><p>{b}</p></article><script>var x = "<p>no</p>";</script><noscript>Turn on scripts please.</noscript><!-- <p>not this</p> --></body>',
    "unclosed": "<body><nav>{menu}</nav><article><h1>Title<p>{a}<p>{b}",
    "header in article": "<body><header><p>A site about many things that people like to read.</p></header><article><header><h1>Title</h1></header><p>{a}</p><p>{b}</p><footer>Filed under: things</footer></article></body>",
    "wrapper": '<body class="no-sidebar has-ads"><div class="sidebar-layout"><div class="content"><article><h1>Title</h1><p>{a}</p><p>{b}</p></article></div><div class="sidebar">{menu}</div></div></body>',
    "form": '<body><article><h1>Title</h1><p>{a}</p><form class="newsletter"><p>Subscribe to our letter and get the news each week by mail.</p><input></form><p>{b}</p></article></body>',
}


@pytest.mark.parametrize("name", SHELLS)
def test_shells(name):
    page = SHELLS[name].format(menu=MENU, a=A, b=B)
    assert H.main_text(page) == f"Title\n\n{A}\n\n{B}"


def test_text_rules():
    page = "<article><h1>A &amp; B</h1><p>one\n\t two&nbsp; three<br>four <b>bold</b><i>er</i> &lt;tag&gt; 1 < 2</p><ul><li>first point of the list</li><li>second point of the list</li></ul><blockquote>He said: &quot;so be it&quot;.</blockquote></article>"
    assert H.main_text(page) == "A & B\n\none two three four bolder <tag> 1 < 2\n\nfirst point of the list\n\nsecond point of the list\n\nHe said: \"so be it\"."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<!--", "<p", "<a href='x", "</p></div>", "<script>", "<nav><a>x</a></nav>", "<![CDATA[x", "<p title=\"x>y", "\x00", "<article></article>"])
def test_broken_pages_do_not_raise(page):
    assert isinstance(H.main_text(page), str)


def test_long_page():
    many = [f"Paragraph number {i} tells of the matter at hand in words enough." for i in range(5000)]
    page = f"<body><nav>{MENU}</nav><article>" + "".join(f"<p>{p}</p>" for p in many) + "</article><footer>end</footer></body>"
    assert H.main_text(page) == "\n\n".join(many)
    assert H.main_text("<div>" * 3000 + A) == A


def energy(costs, links, label):
    e = sum(max(0, -c) if k else max(0, c) for c, k in zip(costs, label))
    return e + sum(w for a, b, w in links if label[a] != label[b])


def test_minimum_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 9)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        links = [(i, i + 1, rng.uniform(0, 2)) for i in range(n - 1)] + [(*rng.sample(range(n), 2), rng.uniform(0, 2)) for _ in range(n if n > 1 else 0)]
        best = min(energy(costs, links, c) for c in itertools.product((False, True), repeat=n))
        assert abs(energy(costs, links, H.min_cut(costs, links)) - best) < 1e-6


def test_op10_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in C.table(spark, sf, "pages").collect()}
    rows = Q.op10_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]["html"]
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", p)).split()) for p in re.split(r"</?p>|</?h1>|</?li>|<br>", body)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_pages_edge_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, f"<p>{A}</p>", "t")], "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in H.extract_pages(df).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("None", A, len(A))]
    assert H.extract_pages(df.limit(0)).collect() == []
