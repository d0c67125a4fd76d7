import html
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm.extract import extract_pages, frame, main_text, template_hashes

PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div id="cookie-notice">We use cookies</div>
<main><article class="post"><header class="entry-header"><h1>Title &amp; more</h1><span class=by>By X</span></header>
<p>First para with <a href="x">link</a> and <em>em</em>.<p>Second&nbsp;para &#8212; a < b &copy 2020
<div class="share-buttons">Share this</div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>x
 y</pre><form>Subscribe</form><aside>Related</aside><script>if(a<b){"</p>"}</script>
<section id="comments"><h2>Comments</h2><article class="comment"><p>nice</p></article></section></article></main>
<div class="sidebar"><p>side</p></div><footer>&copy; me</footer></body></html>"""


def test_article():
    assert main_text(PAGE).split("\n") == ["Title & more", "First para with link and em.", "Second para — a < b © 2020", "one", "two", "a b", "x y"]


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""),
        ("", ""),
        ("plain <3 text", "plain <3 text"),
        ("<p>a<br>b", "a b"),
        ("<p>open <b>x<p>y", "open x\ny"),
        ("<article><p>x</article><p>y", "x"),
        ("<!-- <p>no</p> --><p>yes", "yes"),
        ("<p>a<!-- open", "a"),
        ("<script>x", ""),
        ("<p title='a>b'>c", "c"),
        ("<p>1 &lt; 2 &#x41;&#66; &unknown; &amp;amp;", "1 < 2 AB &unknown; &amp;"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<p hidden>x<p>y", "y"),
        ("<article><div class='ad'>x</div><p class='lead'>y</p></article>", "y"),
        ("</p></div><p>z", "z"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_markup(source, want):
    assert main_text(source) == want


def test_unmarked_article():
    page = "<body><div id=nav><a>Home</a></div><div class=wrap><div class=content><h2>Hello</h2>text one<br>two<p>three is a longer paragraph of text</p></div></div><div class=foot>small</div>"
    assert main_text(page) == "Hello\ntext one two\nthree is a longer paragraph of text"


def expected(h):
    """The generated pages' articles, by their one known layout."""
    a = h[h.index("<article>") + 9 :]
    a = a[: a.index("</article>")] if "</article>" in a else a[: a.index("<footer")]
    blocks = re.split(r"</?(?:p|h1)>", a)
    return "\n".join(y for x in blocks if (y := " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split())))


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = extract_pages(pages).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.text == expected(source[r.page_id]) and r.n_chars == len(r.text)


def site(n, host="a.org"):
    """Pages without article marks, in a frame whose names tell nothing."""
    out = []
    for i in range(n):
        body = f"<h1>Story {i}</h1><p>" + " ".join(f"word{i}x{j}" for j in range(60)) + "</p>"
        out.append((i, f"http://{host}/{i}", f"<body><div class=top><p>Welcome to our site</p><ul><li>Start<li>More</ul></div><div class=x1>{body}</div><div class=end><p>Call us now or never</p></div></body>"))
    return out


SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("limit", [500_000, 0])
def test_templates_go(spark, limit):
    pages = spark.createDataFrame(site(6) + [(100, "http://b.org/", site(1)[0][2])], SCHEMA)
    got = {r.page_id: r.text for r in extract_pages(pages, broadcast_hashes=limit).collect()}
    for i in range(6):
        assert got[i].startswith(f"Story {i}\nword{i}x0") and "Welcome" not in got[i] and "Call us" not in got[i]


def test_copies_are_no_template(spark):
    """One article on many pages of a host is not their frame."""
    page = "<article><div class=b><p>the same long text on all pages</p></div></article>"
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", page) for i in range(8)], SCHEMA)
    assert template_hashes(pages).count() == 0
    assert {r.text for r in extract_pages(pages).collect()} == {"the same long text on all pages"}
    assert frame(None)[1:] == ([], [])


def test_recurrence_decides_inside_articles(spark):
    """Frames without telling names, inside main and article; prose of the article stays."""
    box = "<div class=zz><p>Join 40,000 readers</p><p>today</p></div>"
    page = "<main><div class=k1><p>You are here</p></div><article><h1>T {0}</h1><p>own {0}</p>" + box + "<ul><li>shared point</ul><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>end {0}</p></article></main>"
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", page.format(i)) for i in range(6)], SCHEMA)
    assert {(r.text, r.n_templates) for r in extract_pages(pages).collect()} == {(f"T {i}\nown {i}\nshared point\nend {i}", 3) for i in range(6)}
    once = extract_pages(pages.limit(1)).collect()[0]
    assert "Join 40,000 readers" in once.text and once.n_templates == 0


def test_templates_delete_on_the_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    assert extract_pages(pages).agg({"n_templates": "sum"}).first()[0] > 0


def test_a_class_word_alone_does_not_decide():
    page = "<article><h1>T</h1><div class='related-work'><p>Earlier work</p></div><div class='related-posts'>more</div><div class='related-stuff'><a>x</a></div></article>"
    assert main_text(page) == "T\nEarlier work"


@pytest.mark.parametrize("piece", ["<a ", "<", "</a", "<a b='", "<!-", "<p><button><div>", '<a ">" ', "<li><div>", "&#1"])
def test_time_is_linear(piece):
    start = time.time()
    main_text(piece * (300_000 // len(piece)))
    assert time.time() - start < 10


def test_long_references():
    assert main_text("<p>a&#" + "1" * 10_000 + ";b") == "a\ufffdb"


def test_repeated_paragraphs_of_articles_stay(spark):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", f"<article><h1>T</h1><p>shared passage</p><p>own {i}</p></article>") for i in range(8)], SCHEMA)
    assert {r.text for r in extract_pages(pages).collect()} == {f"T\nshared passage\nown {i}" for i in range(8)}


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "http://a.org/", "<p>x"), (2, "no url", "<p>y"), (2, "no url", "<p>y"), (3, "", ""), (4, "http://a.org", "<p>" + "long " * 50_000)]
    frame_ = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", text string")
    for keep in (("page_id", "text"), ("page_id", "url", "html")):
        assert len(extract_pages(frame_.withColumn("made_host", F.lit(1)), keep=keep).collect()) == len(rows)
    got = extract_pages(frame_).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (2, 1), (2, 1), (3, 0), (4, 249_999)]
    assert extract_pages(frame_.limit(0)).collect() == []
