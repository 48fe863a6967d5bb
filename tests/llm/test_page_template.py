import re

import pytest
from pyspark.sql import types as T

from verdigris.llm import page_template
from verdigris.llm.page_template import main_text

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType())]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], PAGES)


def texts(spark, rows):
    out = page_template.extracted(frame(spark, rows)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    return {r["page_id"]: r["text"] for r in out}


def test_pages_against_their_article(spark, sf):
    """Every page of the tables marks its article; plain cutting gives what stands in it."""
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r["page_id"]: r for r in page_template.extracted(pages).collect()}
    assert len(rows) == pages.count()
    for page in pages.collect():
        body = re.search(r"<article>(.*)</article>", page["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", body)
        plain = " ".join(x for p in parts if (x := re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip()))
        assert rows[page["page_id"]]["text"] == plain
        assert rows[page["page_id"]]["url"] == page["url"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style></head><body class="cookie-page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>More</ul></nav>
<div id="cookie-notice">We use cookies</div>
<article id=a><h1>Head &amp; line</h1><p>One <b>bo</b>ld  &lt;word&gt;<p>Two{n}<br>three
<aside>side</aside><form><input value="x">form</form><script>var a = "</p><p>no";</script>
<div class="ad-box">buy</div><!-- <p>gone</p> --><figure>cap</figure></p>
<section class="comments"><article>nice post</article></section></article>
<footer>foot</footer></body></html>"""


def test_article_without_the_rest(spark):
    got = texts(spark, [(f"http://h.org/{i}", PAGE.format(n=i)) for i in range(5)])
    assert got == {i: f"Head & line One bold <word> Two{i} three cap" for i in range(5)}


def test_template_text_goes_without_an_article(spark):
    page = "<html><body><div class='top'>Welcome to us</div><div class='x'><p>Story {n} is told</p><p>All rights held</p></div><div>Call now</div></body></html>"
    got = texts(spark, [(f"http://h.org/{i}", page.format(n=i)) for i in range(6)] + [("http://other.org/", page.format(n=9))])
    assert [got[i] for i in range(6)] == [f"Story {i} is told" for i in range(6)]
    assert got[6] == "Welcome to us Story 9 is told All rights held Call now"


def test_template_text_goes_inside_articles(spark):
    """A notice under plain tags inside every article is the template's; copies of an article are not, short pages have slots too."""
    page = "<body><div>Top</div><article><h1>Head {n}</h1><p>Story {n} {more}</p><p>Read our weekly letter</p></article></body>"
    rows = [(f"http://h.org/{i}", page.format(n=i, more="is told at some length here " * (i > 0))) for i in range(9)]
    copies = [("http://h.org/c", "<body><article><p>A copied story of some length</p><p>Told once more</p></article></body>")] * 4
    got = texts(spark, rows + copies + [("http://other.org/", page.format(n=9, more="x"))])
    assert [got[i] for i in range(9)] == [f"Head {i} Story {i}" + " is told at some length here" * (i > 0) for i in range(9)]
    assert {got[i] for i in range(9, 13)} == {"A copied story of some length Told once more"}
    assert got[13] == "Head 9 Story 9 x Read our weekly letter"


def test_layouts_that_no_half_of_a_host_has(spark):
    """Menus of three layouts, and a line on 4 of 5 pages, under plain tags on pages without an article."""
    layouts = [
        "<body><div>Home Shop Help</div><div><p>Story {n} is told</p>{line}</div></body>",
        "<body><table><tr><td>All offers of today</td><td>Story {n} is told{line}</td></tr></table></body>",
        "<body><p>Our team and you</p><section>Story {n} is told</section><section>{line}</section></body>",
    ]
    line = "<p>All rights held</p>"
    rows = [(f"http://h.org/{i}", layouts[i % 3].format(n=i, line=line * (i % 5 > 0))) for i in range(30)]
    copy = "<body><div><h2>A tale</h2><p>Told on its own pages, the same each time</p></div></body>"
    got = texts(spark, rows + [("http://h.org/c", copy)] * 6)
    assert [got[i] for i in range(30)] == [f"Story {i} is told" for i in range(30)]
    assert {got[i] for i in range(30, 36)} == {"A tale Told on its own pages, the same each time"}


def test_copies_keep_their_text(spark):
    page = "<body><nav>menu</nav><article><p>The same text</p></article></body>"
    got = texts(spark, [("http://h.org/a", page)] * 8)
    assert set(got.values()) == {"The same text"} and len(got) == 8


def test_odd_pages(spark):
    rows = [
        (None, None), ("", ""), ("no url", "plain < text & more"), ("http://h", "<p>open"), ("http://h", "<article"),
        ("http://h", "<script>never closed"), ("http://h", "<a href='x>y'>link</a>"), ("http://h", "<a href=\"x>quote</a> t"),
        ("http://h", "a<br/>b<hr>c"), ("http://h", "<p>x</p>" * 20000), ("http://h", "<div class='ad'>ad<article>text</article>"),
        ("http://h", "&#65;&nbsp;&eacute;&bogus;"), ("http://h", "<ARTICLE><P>Up</P></ARTICLE>"), ("http://h", "<" * 3000),
        ("http://h", "<!-- open"), ("http://h", "<p>a</p\n>b"),
    ]
    got = texts(spark, rows)
    assert got[0] == got[1] == "" and got[2] == "plain < text & more" and got[3] == "open"
    assert got[5] == "" and got[6] == "link" and got[8] == "a b c" and got[10] == "text"
    assert got[11] == "A é&bogus;" and got[12] == "Up" and got[15] == "a b"
    assert got[9] == " ".join(["x"] * 20000)
    assert texts(spark, []) == {}


@pytest.mark.parametrize("source, text", [
    ("<main><p>in</p></main><p>out</p>", "in"),
    ("<div class='post-content'>in</div><div>out</div>", "in"),
    ("<div role='main'>in</div><div role='navigation'>out</div>", "in"),
    ("<p>no region</p><div class='sidebar-left'>out</div><div hidden>no</div>", "no region"),
    ("<main><article>one</article><article>two</article><div>meta</div></main>", "one two"),
    ("<article><header>By me</header>in<footer>tags</footer></article>", "in"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ("<article>wo<i>rd</i>s and<span> more</span></article>", "words and more"),
    ("<article>in<div class='cookieNotice'>out</div><div id='sidebarBox2'>out</div><div class='commentary'>kept</div></article>", "in kept"),
    ("<div id='mainContent'>wait<div class='articleBody'>in</div></div>", "in"),
])
def test_regions(source, text):
    assert main_text(source) == text


def deduced_by_loops(sources):
    """The template of one host by its classes, written as plain loops over whole occurrence vectors, and each page's text."""
    parsed = [page_template._blocks(s) for s in sources]
    vectors, chars = {}, {}
    for n, (elements, blocks) in enumerate(parsed):
        for e in elements:
            vectors.setdefault((e.path, None), [0] * len(sources))[n] += 1
        for text, e in blocks:
            vectors.setdefault((e.path, text), [0] * len(sources))[n] += 1
    classes = {}
    for token, vector in vectors.items():
        classes.setdefault(tuple(vector), []).append(token)
    template = set()
    for vector, tokens in classes.items():
        pages = [n for n, times in enumerate(vector) if times]
        fixed = [t for t in tokens if t[1] is not None]
        own = sum(len(text) * sum(vector) for _, text in fixed)
        whole = sum(len(text) for n in pages for text, _ in parsed[n][1])
        if len(pages) >= 5 and own <= 0.8 * whole:
            template.update(fixed)
    frame = []
    for vector, tokens in classes.items():
        pages = [n for n, times in enumerate(vector) if times]
        for path, text in tokens:
            if text is not None or max(vector) > 1 or len(pages) < 5:
                continue
            below = [(t, e) for n in pages for t, e in parsed[n][1] if f"{e.path}/".startswith(f"{path}/")]
            fixed = sum(len(t) for t, e in below if (e.path, t) in template)
            slots = sum(len(t) for t, _ in below) - fixed
            own = sum(len(t) for t, e in below if e.path == path)
            around = sum(len(t) for n in pages for t, _ in parsed[n][1]) - fixed
            if slots > around / 2 and own <= sum(len(t) for t, _ in below) / 2:
                frame.append(path)
    out = []
    for elements, blocks in parsed:
        best = max((e.path for e in elements if e.path in frame), key=len, default="")
        kept = []
        for text, e in blocks:
            above, _, label = e.path.rpartition("/")
            head = label[:2] in ("h1", "h2", "h3") and best.startswith(f"{above}/")
            if (f"{e.path}/".startswith(f"{best}/") or head) and (e.path, text) not in template:
                kept.append(text)
        out.append(" ".join(kept))
    return out


def _nameless(seed, page):
    """A page whose tags and classes tell nothing; links and offers change from page to page, in three layouts."""
    import random

    rng = random.Random(seed)

    def words(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))

    links = "".join(f"<li>{words(1)}</li>" for _ in range(rng.randrange(2, 7)))
    story = [words(rng.randrange(8, 40)) for _ in range(rng.randrange(2, 7))]
    head, offer = words(4), words(6)
    body = "".join(f"<p>{t}</p>" for t in story)
    layouts = [
        f"<div class=ka><ul>{links}</ul></div><div class=kb>{offer}</div><div class=kc><h1>{head}</h1>{body}<p>Read our letter</p></div><div class=kd>All rights held</div>",
        f"<table><tr><td class=a>Shop Help Home</td><td class=b>{links}</td></tr></table><div class=q><h2>{head}</h2><div class=z>{body}</div></div><div class=r>{offer}</div>",
        f"<div class=s><article><p>{offer}</p></article><span>{words(2)}</span></div><section><h1>{head}</h1><div class=t>{body}<i>Share this</i></div></section>",
    ]
    return f"<html><body>{layouts[page % 3]}</body></html>", " ".join([head, *story])


def test_articles_that_no_name_tells(spark):
    """Equal to the plain loops and to the stories; the template decides nearly all pages, teaser cards in article tags included."""
    made = [_nameless(n, n if n % 3 < 2 else 0) for n in range(60)]
    got = texts(spark, [(f"http://h.org/{i}", source) for i, (source, _) in enumerate(made)])
    assert [got[i] for i in range(60)] == deduced_by_loops([s for s, _ in made]) == [story for _, story in made]
    assert sum(got[i] != main_text(s) for i, (s, _) in enumerate(made)) == 60
    cards = [_nameless(n, 2) for n in range(12)]
    got = texts(spark, [(f"http://c.org/{i}", source) for i, (source, _) in enumerate(cards)])
    assert [got[i] for i in range(12)] == deduced_by_loops([s for s, _ in cards])
    assert [got[i] for i in range(12)] == [story for _, story in cards]
    assert sum(got[i] != main_text(s) for i, (s, _) in enumerate(cards)) == 12


def test_an_article_by_name_counts_where_both_meet(spark):
    """The deduced element lies inside the article element, whose heading and lines around it are kept."""
    page = "<body><p>{n} links</p><article><div>By {n}</div><section><p>Story {n} of many words</p><p>and more {n}</p></section></article></body>"
    got = texts(spark, [(f"http://h.org/{i}", page.format(n=i)) for i in range(6)])
    assert got == {i: f"By {i} Story {i} of many words and more {i}" for i in range(6)}
