"""Extraction of single pages, and templates counted over sites."""

import re

import numpy as np
import pytest

from vantry.llm import site_templates as S

PAGE = """<!doctype html><html><head><title>x</title></head><body class="nav-open"><header><h1>Site</h1></header>
<nav><ul><li>a<li>b</ul></nav><div id="cookie-notice">We use cookies</div><main><article><header><h1>T &amp; U&nbsp;x</h1></header>
<p>One <b>two<br>three<p>Four<div class="share">S</div><ul><li>i1<li>i2</ul><form><input name=q><p>f</p></form>
<table><tr><td>c1<td>c2</table>tail &lt;b&gt; <!-- c --> 5 < 6 <script>var a="</p>";</script>z</article>
<section class="comments"><article class=comment><p>nice</p></article></section></main><aside>side</aside><footer>f</footer>"""


def test_one_page():
    assert S.Page(PAGE).text(lambda h: False).split("\n\n") == ["T & U x", "One two three", "Four", "i1", "i2", "c1", "c2", "tail <b> 5 < 6", "z"]


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p", ""), ("<", "<"), ('<a href="x', ""), ('<p>a<a b="c>d</p>e', "ad\n\ne"), ("</p>x", "x"), ("<script>x", ""),
    ("<div>" * 3000 + "deep", "deep"), ("<body><div>q</div><p>r", "q\n\nr"), ("plain\n text", "plain text"), ("<p hidden>h<p>v", "v"),
    ("<P>a<STYLE>b</STYLE>c", "a c"[:1] + "\n\nc"), ("<p>" + "w " * 50_000, ("w " * 50_000).strip()),
])
def test_odd_pages(html, text):
    assert S.Page(html).text(lambda h: False) == text


def site(n):
    frame = '<body><div class="top">Home of all <b>things</b></div>%s<div><p>All rights kept</p></div></body>'
    rows = [(k, f"http://a.example/{k}", frame % f"<div><h2>Story {k}</h2><p>Body {k}</p><p>Same words</p></div>") for k in range(n)]
    rows += [(100 + k, f"http://b.example/{k}", f"<article><p>To.</p><div>Buy now</div><p>Text {k}</p></article>") for k in range(n)]
    rows += [(200 + k, f"http://c.example/{k}", frame % "<div><p>One copy</p></div>") for k in range(n)]  # one text under many urls
    return rows + [(300, None, "<p>no url</p>"), (301, "x", None), (301, "x", None)]


@pytest.mark.parametrize("most", [S.BROADCAST_TEMPLATES, -1])
def test_templates_go_and_articles_stay(spark, most):
    df = spark.createDataFrame(site(8), "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in S.extract(df, broadcast_most=most).collect()]
    text = dict(got)
    for k in range(8):
        # outside an article a paragraph that every page has is template, inside it only containers are
        assert text[k] == f"Story {k}\n\nBody {k}"
        assert text[100 + k] == f"To.\n\nText {k}"
        assert text[200 + k] == "Home of all things\n\nOne copy\n\nAll rights kept"
    assert text[300] == "no url" and [t for p, t in got if p == 301] == ["", ""]


def test_few_pages_make_no_template(spark):
    df = spark.createDataFrame(site(3), "page_id long, url string, html string")
    assert {r.text for r in S.extract(df).where("page_id = 1").collect()} == {"Home of all things\n\nStory 1\n\nBody 1\n\nSame words\n\nAll rights kept"}
    assert S.extract(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(1, "u", "<p>t", "h", "s")], "page_id long, url string, html string, host string, text string")
    assert S.extract(wide).first().text == "t"


def test_names_of_wrappers_drop_no_article():
    text = lambda html: S.Page(html).text(lambda h: False)
    for wrapper in ("div class='content has-sidebar'", "div id='page' class='with-nav'", "section class='post no-comments'", "div class='content sidebar'", "div id=nav"):
        tag = wrapper.split()[0]
        assert text(f"<body><{wrapper}><article><p>One</p><p>Two</p></article></{tag}></body>") == "One\n\nTwo"
        assert text(f"<body><main><{wrapper}><article><p>One</p></article></{tag}></main></body>") == "One"
    assert text("<body><main><p>One</p><div class=related><article>T</article></div></main></body>").startswith("One")
    assert text("<body><p>One</p><div class=related><article>T</article></div></body>").startswith("One")
    assert text("<body><article><p>One</p><div class='sidebar x'>S</div><div class='cookie-notice'>C</div></article></body>") == "One"


def worded(n):
    """Menus, adverts and notes with other words on each page, articles without an article element and of changing length."""
    word = lambda k, i: f"w{'abcdefghij'[k * 7 % 10]}{'klmnopqrst'[(k + i) % 10]}"
    rows = []
    for k in range(n):
        menu = "".join(f"<li><a href=/{i}>{word(k, i)}</a>" for i in range(2 + k % 3))
        story = "".join(f"<p>Story {word(k, i)} of page {k} goes on {i}</p>" for i in range(3 + k % 4))
        rows.append((k, f"http://d.example/{k}", f"<body><div class='x{k}'><ul>{menu}</ul></div><div class=box{k}>Buy {word(k, 3)}</div><div class=story><h2>T{k}</h2>{story}</div><div id=end>{word(k, 5)} {k}</div></body>"))
    return rows


@pytest.mark.parametrize("most", [S.BROADCAST_TEMPLATES, -1])
def test_shapes_of_changing_words(spark, most):
    df = spark.createDataFrame(worded(9), "page_id long, url string, html string")
    for r in S.extract(df, broadcast_most=most).collect():
        blocks = r.text.split("\n\n")
        assert blocks[0] == f"T{r.page_id}" and len(blocks) == 4 + r.page_id % 4 and all(b.startswith("Story") for b in blocks[1:])
    few = {r.page_id: r.text for r in S.extract(df.where("page_id < 4")).collect()}
    assert all(t.split("\n\n")[0] != f"T{k}" for k, t in few.items())  # too few pages to count on, and no words of the list


def test_word_lists_count_on_small_hosts_only(spark):
    html = "<body><div class='notice'>Note on {0}</div><p>Words {0} in one</p><p>and {0} in two</p></body>"
    rows = [(k, f"http://{'s' if k < 3 else 'l'}.example/{k}", html.format(k) if k != 20 else html.replace("notice", "promo a b").format(k)) for k in range(21)]
    got = {r.page_id: r.text for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert not any("Note" in got[k] for k in range(20)) and "Note on 20" in got[20]


def test_templates_alone_on_given_pages(spark, folder):
    """Without names and without the choice of the article, templates alone remove menus, adverts and footers of larger hosts."""
    sizes, known, pages = {}, set(), [(S_host(r.url), r.html) for r in spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()]
    for h, _ in pages:
        sizes[h] = sizes.get(h, 0) + 1
    df = spark.createDataFrame(pages, "host string, html string")
    known = {r.h for r in S.templates(df).collect()}
    large = same = changed = 0
    for h, html in pages:
        if sizes[h] < 8:
            continue
        page = S.Page(html)
        hit = lambda x, h=h: int(np.uint64(S._key(h, x)).view(np.int64)) in known
        large += 1
        bare = page.text(lambda x: False, by_names=False, by_article=False)
        alone = page.text(hit, by_names=False, by_article=False)
        changed += alone != bare
        same += alone == page.text(hit)
    assert changed > 0.9 * large > 0 and same > 0.7 * large, (large, changed, same)


def S_host(url):
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest)[0].lower()
