"""Pages whose main text is known because it was written first, and defined edge cases."""

import html
import random
import time

import pytest

from folioquery.llm.html_extraction import main_text, named
from folioquery.llm.registry import op8_html_extraction

WORDS = "harbour lantern, quiet morning orchard river, stone the of and winter market bridge letter & window <b> garden".split()


def sentence(r, low, high):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))) + "."


def blocks(r):
    """(markup, texts) of one part of an article."""
    kind = r.choice("p p p p short pre quote list table heading nested entity".split())
    t = sentence(r, 12, 60)
    e = html.escape(t)
    if kind == "short":
        t = sentence(r, 1, 3)
        return f"<p>{html.escape(t)}", [t]
    if kind == "pre":
        return f"<pre>{e}</pre>", [t]
    if kind == "quote":
        return f"<blockquote><p>{e}</p></blockquote>", [t]
    if kind == "list":
        items = [sentence(r, 2, 9) for _ in range(3)]
        return "<ul>" + "".join(f"<li>{html.escape(i)}" for i in items) + "</ul>", items
    if kind == "table":
        a, b = sentence(r, 1, 4), sentence(r, 1, 4)
        return f"<table><tr><td>{html.escape(a)}</td><td>{html.escape(b)}</td></tr></table>", [f"{a} {b}"]
    if kind == "heading":
        h = sentence(r, 2, 5)
        return f"<h3 class='market-share'>{html.escape(h)}</h3><p>{e}</p>", [h, t]
    if kind == "nested":
        return f"<div class='has-sidebar'><div>{e}</div></div>", [t]
    if kind == "entity":
        return f"<p>{e}&nbsp;caf&eacute;<br>end</p>", [f"{t} café end"]
    return f"<p id=x{r.randint(0, 9)}>{e}</p>", [t]


FURNITURE = [
    "<nav><ul><li><a href='/a'>Home and more</a></li></ul></nav>", "<div class='ad'>Buy, buy, buy this now, or later, or never, but do buy it.</div>", "<aside><p>Elsewhere, on this site, a longer text, that nobody asked for.</p></aside>",
    "<form><p>Sign, here</p><input name=a><button>Go</button></form>", "<script>var a = '<p>no</p>';</script>", "<div id='cookie-banner'>We use cookies, and so on, and so on.</div>", "<div class='comments'><p>Great, post, really, nice.</p></div>",
    "<div role='navigation'><a href='#'>x</a></div>", "<p hidden>not seen, at all</p>", "<style>p{color:red}</style>", "<div class='sidebar widget-area'>Popular, posts, of, the, week</div>", "<!-- <p>remark</p> -->",
]


@pytest.mark.parametrize("shape", ["article", "main", "div", "body", "implied", "fragment", "wrapped", "two articles", "two divs", "form"])
def test_planted_articles(shape):
    r = random.Random(shape)
    for _ in range(60):
        parts = [blocks(r) for _ in range(r.randint(3, 12))]
        if len("".join(t for _, p in parts for t in p)) < 600:
            parts.append((f"<p>{html.escape('long, ' * 120)}</p>", [("long, " * 120).strip()]))
        expected = "\n\n".join(t for _, p in parts for t in p)
        markup = []
        for m, _ in parts:
            markup.append(m)
            if r.random() < 0.3:
                markup.append(r.choice(FURNITURE))
        half, body = len(markup) // 2, "".join(markup)
        top, end = r.choice(FURNITURE), r.choice(FURNITURE) + "<footer><p>Copyright, all rights, reserved.</p></footer>"
        page = {
            "article": f"<html><body>{top}<article>{body}</article>{end}</body></html>",
            "main": f"<html><body>{top}<div role='main'>{body}</div>{end}</body></html>",
            "div": f"<html><head><title>t</title></head><body>{top}<div class='post-with-comments'>{body}</div>{end}</body></html>",
            "body": f"<body>{top}{body}{end}</body>",
            "implied": f"<title>t</title>{top}{body}{end}",
            "fragment": body,
            "wrapped": f"<body><div class='sidebar-container'>{top}<main>{body}</main>{end}</div></body>",
            "two articles": f"<body>{top}<article>{''.join(markup[:half])}</article>{top}<article>{''.join(markup[half:])}</article>{end}</body>",
            "two divs": f"<body>{top}<div><section>{''.join(markup[:half])}</section></div>{top}<div>{''.join(markup[half:])}</div>{end}</body>",
            "form": f"<body><form id=whole><h1>Head</h1>{body}</form></body>",
        }[shape]
        if shape == "form":
            expected = "Head\n\n" + expected
        assert main_text(page) == expected, page


@pytest.mark.parametrize(
    "page, text",
    [
        ("plain text, no tags", "plain text, no tags"), ("a < b and c > d", "a < b and c > d"), ("<pre>at the\n root</pre>", "at the root"), ("<h1>Only</h1>", "Only"), ("<p>one<p>two", "one\n\ntwo"),
        ("<head><title>t</title><p>body is implied</p>", "body is implied"), ("<div class='title'><h1>T</h1></div><div><p>long, long, " + "text " * 40 + "</p></div><div>End.</div>", "T\n\nlong, long, " + ("text " * 40).strip() + "\n\nEnd."),
        ("<div><h1>T</h1></div><article><p>" + "text, " * 40 + "</p></article><div>Unmarked text beside it.</div>", "T\n\n" + ("text, " * 40).strip()),
        ("<div class='sidebar'><h1>All</h1><p>" + "word, " * 50 + "</p></div>", "All\n\n" + ("word, " * 50).strip()), ("<nav>only menu</nav>", ""), ("<p>&#x1F600;&amp;</p>", "\U0001f600&"), ("</div></p><p>stray", "stray"),
        ("<body><div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div><p>" + "some, text " * 30 + "</p></div>", ("some, text " * 30).strip()), ("", ""), (None, ""), ("   ", ""), ("<article><p>cut</p><p cla", "cut"),
    ],
)
def test_edge_cases(page, text):
    assert main_text(page) == text


def test_names():
    assert [named(t) for t in "sidebar cookie-banner siteFooter ad-1 has-sidebar post-with-comments market-share content lead".split()] == [1, 1, 1, 1, 0, 0, 2, 0, 0]


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<i>" * 60_000 + "</b>" * 60_000, "<p>word, " * 60_000, "<header>" * 30_000, "</div>" * 100_000, "a<" * 100_000, "x" * 2_000_000])
def test_long_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 20


def test_registered_query(spark, tmp_path):
    rows = [(1, "u", "<p>a &amp; é</p>", "x"), (1, "u", "<p>a &amp; é</p>", "x"), (2, None, None, "y"), (None, "v", "<nav>n</nav>", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op8_html_extraction(spark, str(tmp_path))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "a & é", 5), (1, "u", "a & é", 5), (2, None, "", 0), (None, "v", "", 0)], key=repr)


@pytest.mark.parametrize("box", ["<article>{}</article>", "<div>{}</div>", "<main><div>{}</div></main>"])
def test_nouns_of_classes_decide(box):
    prose = "".join(f"<p>Paragraph {i}, with commas, and words enough, to be the article of this page.</p>" for i in range(8))
    text = [f"Paragraph {i}, with commas, and words enough, to be the article of this page." for i in range(8)]
    for name in ("reader-comments", "user-comments", "fb-comments", "adsbygoogle", "google-ad", "dfp-ad", "cookie-law-bar", "breadcrumb-trail", "email-signup", "alert", "siteNotice", "promo-2"):
        assert main_text(f"<body>{box.format(prose + f'<div class={name}><p>We use cookies, and more, and say so here.</p></div>')}</body>") == "\n\n".join(text), name
    said = "Share price rose, said the board, and it will rise again, said others."
    for name in ("share", "market-share", "social", "overflow-hidden", "cookie-recipe", "hero-banner-text-body-copy"):
        got = main_text(f"<body>{box.format(prose[: prose.index('<p>Paragraph 4')] + f'<div class={name}><p>{said}</p></div>' + prose[prose.index('<p>Paragraph 4') :])}</body>")
        assert got == "\n\n".join([*text[:4], said, *text[4:]]), name
    links = "<div class=share>Share: <a href=#>on the first site</a> <a href=#>on the second</a></div><div class=social><button>Like</button> this page</div>"
    assert main_text(f"<body>{box.format(prose + links)}</body>") == "\n\n".join(text)
