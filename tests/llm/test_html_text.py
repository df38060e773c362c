import re
import time
from html import unescape

import pytest

from linkloom.llm import html_text as H

GOOD = "This is the first paragraph of the article, and it is long enough to be judged by the rules as it has many of the words that are in a text, and so it goes on for a while until it is over two hundred characters long."
OTHER = "Here is the second of the paragraphs; it was written for the same reason as the first one and has as many of the common words in it, so that the rules have something to go by when they look at it in turn, as they do."


def text(html):
    return H.main_text(html)[0]


@pytest.mark.parametrize("html", [None, "", " ", "<!-- a", "<p>", "<<<>>>", "</p></div>", "<script>", "<a href='x", "&", "&#0;&#xD800;", "<p " * 1000])
def test_nothing(html):
    assert isinstance(text(html), str)


def test_marked_article():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy the best of all the things that are in the shop</div><!-- {GOOD} -->
    <article><h1>The  title &amp;\n more</h1><p>{GOOD}<br>After&nbsp;it.<p>Short.</p><div class="share-buttons">Share this</div><ul><li>One<li>Two</ul>
    <section id="comments"><p>{OTHER}</p></section><form><p>{OTHER}</p></form></article><aside><p>{OTHER}</p></aside><div id="cookie-notice"><p>{OTHER}</p></div><footer>&copy; {OTHER}"""
    assert text(html) == f"The title & more {GOOD} After it. Short. One Two"


def test_page_without_marks():
    html = f"""<body class="has-sidebar"><div>Log in</div><ul><li><a href=a>News</a><li><a href=b>Sport</a></ul><h2>A title of it</h2><p>{GOOD}</p><p>Short one.</p><p>{OTHER}</p>
    <p><a href=x>{GOOD}</a></p><div>All rights reserved</div><div>Contact</div></body>"""
    assert text(html) == f"A title of it {GOOD} Short one. {OTHER}"


def test_article_by_name():
    html = f"""<div id="content"><header>Top of the page</header><div class="post-body"><h2>Title</h2><p>Short.</p><p>{GOOD}</p><p>End.</p></div><div class="post-comments"><p>{OTHER}</p></div></div>
    <div class="other"><p>{OTHER}</p></div>"""
    assert text(html) == f"Title Short. {GOOD} End."


def test_unclosed_paragraphs_end_with_the_next_block():
    assert text(f'<main><p class="ad">Advert<p>{GOOD}<p><b>x<p>y</main>') == f"{GOOD} x y"


def test_words_are_not_split_by_inline_tags():
    assert text("<article><p>a<b>b</b>c <i>d</i>e&lt;p&gt;</article>") == "abc de<p>"


def test_hidden_parts():
    assert text('<article><p hidden>a</p><p style="display: none">b</p><p aria-hidden="true">c</p><p role="navigation">d</p><p>e</p></article>') == "e"


def test_link_lists_in_an_article_go():
    assert text(f'<article><p>{GOOD}</p><p><a href=a>One thing</a> <a href=b>another</a></p></article>') == GOOD


@pytest.mark.parametrize("html, want", [
    (f"<h1><a href=t>Title</a></h1><p>{GOOD}</p>", f"Title {GOOD}"),
    (f"<p>{GOOD}</p><p><a href=a>All of it is a link</a></p><p>The end.</p>", f"{GOOD} All of it is a link The end."),
    (f"<p>{GOOD}</p><p><a href=a>Smith</a> and <a href=b>Jones</a></p>", f"{GOOD} Smith and Jones"),
    (f"<div><a href=a>{GOOD}</a></div>", GOOD),
    (f"<h1>Title</h1><p><a href=a>One</a> | <a href=b>Two</a></p><p>Short.</p><ul><li><a href=c>Three</a></ul><p>The end.</p>", "Title Short. The end."),
])
def test_linked_text_in_an_article_stays(html, want):
    assert text(f"<article>{html}</article>") == want
    assert text(f"<ul><li><article>{html}</article></li></ul>") == want


@pytest.mark.parametrize("after", ["<body><article>{}</article>", "<article>{}</article>", "<script>x</script>\n<main>{}", "<h1></h1><article>{}"])
def test_head_without_its_end(after):
    page = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><link rel=x>" + after.format(f"<p>{GOOD}</p>")
    assert text(page) == GOOD
    assert text("<head><title>T</title>" + GOOD) == GOOD


@pytest.mark.parametrize("attributes, stays", [
    ('title="the hidden cost"', True), ("title='a hidden'", True), ("data-a=hidden", True), ('data-role="navigation"', True), ("""title='class="ad"'""", True),
    ("hidden", False), ("HIDDEN=''", False), ('class="a"hidden', False), ('hidden="until-found" title="x"', False), ("a = b hidden", False),
])
def test_attributes_count_by_name(attributes, stays):
    assert text(f"<article><div {attributes}><p>{GOOD}</p></div><p>{OTHER}</p></article>") == (f"{GOOD} {OTHER}" if stays else OTHER)


def test_very_long_and_deep():
    assert len(text("<article>" + f"<p>{GOOD}</p>" * 5000)) == 5000 * (len(GOOD) + 1) - 1
    assert text("<article>" + "<div>" * 3000 + "x") == "x"


def test_neighbours():
    b = [H.Block(t, 0, False, False, 0) for t in ("short", GOOD, "short", GOOD, "short", LISTING, "short")]
    H.judge(b)
    assert [x.label for x in b] == [H.BAD, H.GOOD, H.GOOD, H.GOOD, H.BAD, H.BAD, H.BAD]
    for x in b:
        x.kind, x.label = "text", ""
    H.judge(b)  # a paragraph at the edge takes the only neighbour that is decided
    assert [x.label for x in b] == [H.GOOD, H.GOOD, H.GOOD, H.GOOD, H.BAD, H.BAD, H.BAD]


LISTING = "no common words here whatsoever, merely nouns, verbs, adjectives, adverbs, punctuation marks! " * 2 + "Cheap flights, hotels, tickets"
RUSSIAN = "Это первый абзац статьи, он написан достаточно длинно, чтобы его можно было оценить по длине, и потому продолжается ещё некоторое время, пока не станет длиннее двухсот знаков, а затем спокойно заканчивается точкой."
CHINESE = "这是文章的第一段它写得足够长以便可以按照长度来判断所以它还会继续一段时间直到超过两百个字符然后安静地结束" * 5


def test_passes_decide_without_marks(monkeypatch):
    """Stop words tell a text from a list of keywords, links a menu, and neighbours decide what is short; without the lists the result is another."""
    html = f"<body><div>Top</div><p>{LISTING}</p><h2>Title</h2><p>{GOOD}</p><p>Short.</p><p>{OTHER}</p><div>{LISTING}</div><div>Bottom</div></body>"
    assert text(html) == f"Title {GOOD} Short. {OTHER}"
    monkeypatch.setattr(H, "STOP_WORDS", frozenset())
    assert text(html) != f"Title {GOOD} Short. {OTHER}"
    monkeypatch.undo()
    for name, value in (("SHORT", 10**6), ("LINKS", 0.0), ("LONG", 10**6)):
        monkeypatch.setattr(H, name, value)
        assert text(html.replace("Short.", "A <a href=x>short</a> one.")) != f"Title {GOOD} A short one. {OTHER}"
        monkeypatch.undo()


def test_passes_decide_within_an_article():
    """The heading of a link list goes with it; a table and a listing stay."""
    menu = "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    assert text(f"<article><h1>Title</h1><p>{GOOD}</p><h3>See also</h3>{menu}{menu}</article>") == f"Title {GOOD}"
    assert text(f"<article><h1>Title</h1><p>{GOOD}</p><h3>Data</h3><pre>{LISTING}</pre><p>End.</p></article>") == f"Title {GOOD} Data {LISTING} End."


@pytest.mark.parametrize("body", [RUSSIAN, CHINESE, "Hello world."])
def test_other_scripts_and_short_pages(body):
    assert text(f"<body><p>{body}</p></body>") == body
    assert text(f"<article><h1>Ж</h1><p>{body}</p></article>") == f"Ж {body}"
    assert text(f"<nav>x</nav><h1>Заголовок</h1><p>{body}</p><p>Да.</p><footer>y</footer>") == f"Заголовок {body} Да."
    assert text(body) == body
    assert text(f"<body><p>{GOOD}</p><p>{body}</p><p>{OTHER}</p></body>") == f"{GOOD} {body} {OTHER}"


@pytest.mark.parametrize("name, stays", [("search-methods", True), ("share-of-votes", True), ("notice-period", True), ("skip-lists", True), ("search", False), ("share-buttons", False), ("social share", False), ("notice box", False), ("related-posts", False), ("x newsletter-signup-form y", False)])
def test_names_in_an_article(name, stays):
    assert text(f'<article><p>{GOOD}</p><section class="{name}"><p>{OTHER}</p></section></article>') == (f"{GOOD} {OTHER}" if stays else GOOD)


def test_formulas_stay():
    assert text(f"<article><p>{GOOD} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>") == f"{GOOD} x=2"


@pytest.mark.parametrize("piece", ["<svg>", "<div>", "<p>", "<b>", "<li>", "<b><hr>", "<h1>", "<a href=x>y", "<span></i>", "</div>", "<object><p>x", "<!-- ", "<a '", "<ul><li><b>x", "&amp", "<title", "<td><i>x</u>"])
def test_time_grows_with_length_only(piece):
    def seconds(n):
        began = time.perf_counter()
        text(piece * n + f"<p>{GOOD}")
        return time.perf_counter() - began

    seconds(2000)
    small, large = min(seconds(1000) for _ in range(3)), seconds(16_000)
    assert large < 16 * 4 * max(small, 0.002)


PAGES = "page_id long, url string, html string, text string, n_good int"


def test_table(spark):
    rows = [(1, "u", f"<article>{GOOD}</article>", "x", 1), (1, "u", f"<article>{GOOD}</article>", "x", 1), (None, None, None, None, None), (2, "v", "", "", 0)]
    got = sorted(map(tuple, H.extract(spark.createDataFrame(rows, PAGES)).select("page_id", "url", "text", "n_chars").collect()), key=repr)
    assert got == sorted([(1, "u", GOOD, len(GOOD))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


def own_text(html):
    """A page's article, cut out by its tags."""
    inner = re.search("<article>(.*)</article>", html, re.S)[1]
    parts = (" ".join(unescape(re.sub("</?b>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", inner))
    return " ".join(p for p in parts if p)


def test_query(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = H.op6_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == own_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_pages_without_their_marks(spark):
    """Without article tags it is the passes alone that find the same texts."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = sum(text(re.sub("</?article>", "", h)) == own_text(h) for h in pages)
    assert same >= 0.98 * len(pages)
