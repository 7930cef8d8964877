"""Layouts that the trees were not fitted to, and the decoding against all labellings of small trees."""

import itertools
import random

import pytest

from tidewatch.llm import html_extract as H

WORDS = "river stone early winter garden paper seven letters morning bridge quiet window market silver candle forest yellow harbour ticket engine basket".split()


@pytest.fixture(scope="module")
def trees(spark):
    return H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def layouts():
    """(name, html of the article's inside, its text)."""
    rng = random.Random(21)
    w = lambda n: words(rng, n)
    a, b, c, d, e, f = w(30), w(25), w(4), w(6), w(12), w(28)
    around = lambda inner: f"<h1>{c}</h1><p>{a}.</p>{inner}<p>{b}.</p>"
    text = lambda *lines: "\n".join([c, f"{a}.", *lines, f"{b}."])
    yield "ul", around(f"<ul><li>{d}</li><li>{e}</li></ul>"), text(d, e)
    yield "ol", around(f"<ol><li>{e}</li><li>{d}</li><li>{f}</li></ol>"), text(e, d, f)
    yield "table", around(f"<table><tr><th>{c}</th><th>{d}</th></tr><tr><td>{d}</td><td>{e}</td></tr></table>"), text(c, d, d, e)
    yield "caption", around(f"<table><caption>{d}</caption><tr><td>{e}</td></tr></table>"), text(d, e)
    yield "quote", around(f"<blockquote>{e}</blockquote>"), text(e)
    yield "quoted paragraphs", around(f"<blockquote><p>{e}</p><p>{d}</p></blockquote>"), text(e, d)
    yield "pre", around(f"<pre>{d}\n   {e}</pre>"), text(f"{d} {e}")
    yield "figure", around(f"<figure><img src=x.png alt=no><figcaption>{e}</figcaption></figure>"), text(e)
    yield "dl", around(f"<dl><dt>{c}</dt><dd>{e}</dd></dl>"), text(c, e)
    yield "section", around(f"<section><h2>{d}</h2><p>{f}</p></section>"), text(d, f)
    yield "nested", around(f"<div><div><p>{f}</p></div></div>"), text(f)
    yield "list of paragraphs", f"<h1>{c}</h1><ol><li><p>{a}</p></li><li><p>{b}</p></li></ol>", f"{c}\n{a}\n{b}"
    yield "ol alone", f"<h1>{c}</h1><ol><li>{a}</li><li>{b}</li><li>{f}</li></ol>", "\n".join((c, a, b, f))
    yield "header", f"<header><h1>{c}</h1></header><p>{a}.</p><p>{b}.</p>", text()
    yield "sub-headings", around(f"<h2>{d}</h2><p>{f}</p><h3>{c}</h3><p>{e}</p>"), text(d, f, c, e)
    yield "advert between", around(f'<div class="ad">{e}</div>'), text()
    yield "aside between", around(f"<aside><h4>{d}</h4><ul><li><a href=/a>{c}</a></li></ul></aside>"), text()
    yield "share between", around(f'<div class="share"><ul><li><a href=/a>{c}</a></li><li><a href=/b>{c}</a></li></ul></div>'), text()
    yield "form between", around(f"<form><label>{d}</label><select><option>{c}</option></select><button>{c}</button></form>"), text()
    yield "list then advert", around(f'<ul><li>{d}</li><li>{e}</li></ul><div class="advert"><p>{f}</p></div>'), text(d, e)


@pytest.mark.parametrize("box", ["article", "main", 'div class="content"'])
def test_layouts(trees, box):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><div class="logo">Daily Site</div></header><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
        '<{box}>{inside}</{end}><div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One thing</a></li></ul></div><section id="comments"><h2>Comments</h2><div class="comment"><p>I like this very much indeed.</p></div></section>'
        "<footer><p>All rights reserved by the site.</p></footer></body></html>"
    )
    wrong = {}
    for name, inside, want in layouts():
        parsed = H.parse(page.format(box=box, inside=inside, end=box.split()[0]))
        got = H.text_of_page(parsed, H.decode(parsed, trees.odds(H.features(parsed))))
        if got != want:
            wrong[name] = (got, want)
    assert not wrong


def short_pages(box):
    """(html, text): articles of one to five words beside and around bare or role-marked boilerplate."""
    end = box.split()[0]
    head = "<html><body>"
    tail = "</body></html>"
    befores = ("<nav>Menu</nav>", "<header>Daily Site</header>", "<nav>Home News About</nav>", "<div role=navigation>Start here</div>", '<div role="banner">The Site</div>', "")
    afters = ("<footer>F</footer>", "<footer>All rights reserved</footer>", '<div role="contentinfo">Legal</div>', '<div role="complementary">See also</div>', "<aside>Popular today</aside>", "")
    insides = (
        ("<h1>T</h1><p>Ok.</p>", "T\nOk."), ("<h1>Short news</h1><p>It rained.</p><p>We stayed in.</p>", "Short news\nIt rained.\nWe stayed in."), ("<p>Nothing to report today.</p>", "Nothing to report today."),
        ("<h1>F</h1><nav>On this page</nav><p>Text follows here.</p>", "F\nText follows here."), ("<h1>News</h1><p>It is done.</p><button>Share</button>", "News\nIt is done."), ("<h1>One</h1><p>Two three.</p><aside>Four five</aside><p>Six.</p>", "One\nTwo three.\nSix."),
        ("<h1>Head</h1><p>Body words.</p><footer>Filed under news</footer>", "Head\nBody words."), ("<header><h1>Title</h1></header><p>Body.</p>", "Title\nBody."),
    )
    for before, after, (inside, text) in itertools.product(befores, afters, insides):
        yield f"{head}{before}<{box}>{inside}</{end}>{after}{tail}", text


@pytest.mark.parametrize("box", ["article", "main", 'div role="main"', 'div class="content"'])
def test_short_and_role_marked_pages(trees, box):
    wrong, n = [], 0
    for source, want in short_pages(box):
        parsed = H.parse(source)
        got = H.text_of_page(parsed, H.decode(parsed, trees.odds(H.features(parsed))))
        n += 1
        if got != want:
            wrong.append((source, got))
    assert not wrong, (len(wrong), n, wrong[:6])


def test_decoding_is_the_best_consistent_labelling():
    """Outside, content, excluded: down a path never back. All labellings of trees of up to seven elements."""
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 7)
        page = H.Page(["#root"] + ["div"] * (n - 1), [-1] + [rng.randrange(i) for i in range(1, n)], [""] * n, [(i, i, "x" * rng.randint(0, 30)) for i in range(n)])
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        size = [len(text) for _, _, text in page.runs]
        gain = [o * (H.NODE + H.math.log1p(s)) for o, s in zip(odds, size, strict=True)]
        worth = lambda kept: sum(g if k else -g for g, k in zip(gain[1:], kept[1:], strict=True))
        best = max(worth([s == 1 for s in states]) for states in itertools.product((0, 1, 2), repeat=n) if states[0] == 0 and all(states[page.parents[i]] <= states[i] for i in range(1, n)))
        assert worth(H.decode(page, odds)) == pytest.approx(best)


def test_long_pages_take_time_by_their_length():
    import time

    began = time.perf_counter()
    for source in ("<div>" * 40_000 + "x" + "</b>" * 40_000, "<b>" * 40_000 + "<div>x" * 2_000, "<ul>" + "<li>a" * 60_000, "<p>a" * 60_000):
        H.parse(source)
    assert time.perf_counter() - began < 20


def test_extra_columns_nulls_and_sampling(spark, trees):
    pages = spark.createDataFrame([(1, "u", "<article><p>" + "some words here. " * 40 + "</p></article>", "a", 1), (1, None, None, "b", 2), (None, "v", "", None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(pages, trees).orderBy("page_id", "url").collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(None, "v", 0), (1, None, 0), (1, "u", len("some words here. " * 40) - 1)]
    assert H.extract(pages.limit(0), trees).count() == 0 and H.fit(pages.limit(0)).leaves
    again = pages.unionByName(pages).repartition(3)
    assert H.fit(again, sample_pages=5).leaves == H.fit(pages, sample_pages=5).leaves
