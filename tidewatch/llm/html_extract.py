"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree. Each element gets features of its tag, attribute tokens, depth, siblings
and the density of text and links in its subtree. Boosted trees give the log-odds that an element belongs
to the article. A dynamic program over the tree then picks the most likely consistent labelling: going
down from the root, elements are outside, then content, then excluded, never back, so an advert inside the
article takes all below it out and no part of a menu comes back in.

Pages carry no labels, so the trees are fitted to a bounded sample whose labels come from its markup, with
boilerplate and content of many forms (lists, tables, quotations, figures, nested sections) grafted in and the article's own
container renamed.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button output".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
KINDS = ("p", "h1 h2 h3 h4 h5 h6", "a", "li", "ul ol menu dl", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "button select option input label fieldset textarea", "table tbody tr td th", "span b i em strong small", "body html", "blockquote pre figure figcaption dd dt")
GOOD = frozenset("article articlebody body content entry main post story text page prose paragraph".split())
BAD = frozenset("ad ads advert advertisement adverts advertising adsbygoogle alert announcement author avatar banner bar breadcrumb breadcrumbs byline cart comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion feedback foot footer form gdpr head header hidden legal links login logo masthead menu meta modal nav navbar navigation newsletter note notice notification outbrain overlay pager pagination popular popup print promo promoted promotion recommended related replies reply respond reviews rss search share sharing sidebar side signup skip social sponsor sponsored sponsors subscribe subscription tags teaser toc toolbar tools top trending widget widgets".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Elements by index in page order (0 is the root), and text runs (element, block, raw text)."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    runs: list[tuple[int, int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """Elements and text of a page, with the usual tolerance: optional end tags, stray end tags, unclosed elements, cut pages."""
    page, stack, block, at = Page(), [0], 0, 0
    tags, opened = page.tags, Counter()

    def close(depth: int) -> None:
        for i in stack[depth:]:
            opened[tags[i]] -= 1
        del stack[depth:]

    while True:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            page.runs.append((stack[-1], block, text))
        if not m:
            return page
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                block += 1
            if opened[name]:
                depth = len(stack) - 1
                while tags[stack[depth]] != name:
                    depth -= 1
                close(depth)
            continue
        if name == "br":
            page.runs.append((stack[-1], block, " "))
            continue
        if name not in INLINE:
            block += 1
        if name in VOID:
            continue
        if name in CLOSES_P or name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            limit = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}.get(name)
            for depth in range(len(stack) - 1 if limit or opened["p"] else 0, 0, -1):
                tag = tags[stack[depth]]
                if limit is None and tag == "p" or limit is not None and (tag == name or {tag, name} in ({"dd", "dt"}, {"td", "th"})):
                    close(depth)
                    break
                if limit is None and tag not in INLINE or limit is not None and tag in limit:
                    break
        index = len(tags)
        tags.append(name)
        page.parents.append(stack[-1])
        page.attributes.append(m[3] or "")
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif not (m[3] or "").endswith("/") or name in INLINE or name in CLOSES_P:
            stack.append(index)
            opened[name] += 1


def attribute_tokens(attributes: str) -> set[str]:
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key in ("class", "id", "role", "itemprop", "aria-label") and m[2]:
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2])
            found.update(PART.findall(value.lower()))
        elif key in ("hidden", "aria-hidden"):
            found.add("hidden")
    return found


FEATURES = len(KINDS) + 25


def features(page: Page):
    """A row of FEATURES numbers for each element."""
    import numpy as np

    n = len(page.tags)
    kind_of = {tag: k for k, group in enumerate(KINDS) for tag in group.split()}
    own, linked, subtree, links, tags, depth = (np.zeros(n) for _ in range(6))
    marks = np.zeros(n)
    before = np.full(n, -1.0)
    total = 0.0
    for i, _, text in page.runs:
        length = len(text.split()) and len(text)
        own[i] += length
        marks[i] += sum(text.count(c) for c in ".,;:!?")
        if length and before[i] < 0:
            before[i] = total
        total += length
    in_link, good, bad, good_above, bad_above, semantic, excluded, headed = (np.zeros(n) for _ in range(8))
    child, children, same = np.zeros(n), np.zeros(n), np.zeros(n)
    counts: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p, tag = page.parents[i], page.tags[i]
        tokens = attribute_tokens(page.attributes[i]) if page.attributes[i] else ()
        depth[i] = depth[p] + 1
        in_link[i] = in_link[p] or tag == "a"
        good[i], bad[i] = len(GOOD.intersection(tokens)), len(BAD.intersection(tokens))
        good_above[i], bad_above[i] = good_above[p] + (good[p] > 0), bad_above[p] + (bad[p] > 0)
        semantic[i] = semantic[p] or page.tags[p] in ("article", "main")
        excluded[i] = excluded[p] or page.tags[p] in ("nav", "footer", "aside", "form")
        headed[i] = headed[p] or page.tags[p] == "header"
        child[i] = children[p]
        children[p] += 1
        same[i] = counts.get((p, tag), 0)
        counts[p, tag] = int(same[i]) + 1
    linked = own * in_link
    subtree, links, tags, marked = own.copy(), linked.copy(), np.ones(n), marks.copy()
    first = np.where(before < 0, np.inf, before)
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        subtree[p] += subtree[i]
        links[p] += links[i]
        tags[p] += tags[i]
        marked[p] += marked[i]
        first[p] = min(first[p], first[i])
    parents = np.maximum(page.parents, 0)
    x = np.zeros((n, FEATURES))
    for i, tag in enumerate(page.tags):
        if tag in kind_of:
            x[i, kind_of[tag]] = 1
    siblings = np.array([counts.get((p, t), 1) for p, t in zip(page.parents, page.tags, strict=True)])
    k = len(KINDS)
    rest = (
        np.log1p(own), np.log1p(subtree), links / np.maximum(subtree, 1), subtree / tags, marked / np.maximum(subtree, 1), tags, depth, good, bad,
        np.minimum(good_above, 3), np.minimum(bad_above, 3), semantic, excluded, in_link, child, child / np.maximum(children[parents], 1), siblings, same / siblings,
        subtree / max(total, 1), subtree / np.maximum(subtree[parents], 1), np.minimum(first, total) / max(total, 1), children, subtree[parents] / max(total, 1), bad[parents], headed,
    )
    for j, column in enumerate(rest):
        x[:, k + j] = column
    return x


@dataclass
class Trees:
    """Boosted trees of fixed depth: for each tree the features and thresholds of its inner nodes by level order, and its leaves."""

    base: float
    splits: list[tuple[list[int], list[float]]]
    leaves: list[list[float]]

    def odds(self, x):
        import numpy as np

        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for (names, limits), leaves in zip(self.splits, self.leaves, strict=True):
            names, limits, node = np.array(names), np.array(limits), np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, names[node]] > limits[node])
            total += np.array(leaves)[node - len(names)]
        return total


DEPTH, BINS = 4, 24
#: What an element without text of its own counts in the decoding, and in the fit, where one with ``n`` characters counts log(1 + n) more.
NODE, NODE_FIT = 1.0, 0.5


def boost(x, y, weight, trees: int = 40, rate: float = 0.25, ridge: float = 2.0) -> Trees:
    """Trees for the logistic loss, grown level by level on quantile histograms with Newton leaves."""
    import numpy as np

    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(limit, x[:, j], side="left") for j, limit in enumerate(limits)], axis=1)
    mean = float(np.average(y, weights=weight))
    base = math.log(max(mean, 1e-3) / max(1 - mean, 1e-3))
    total, splits, leaves = np.full(len(y), base), [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
        node, names, cuts = np.zeros(len(y), int), [], []
        for level in range(DEPTH):
            width = 1 << level
            gain_best = np.full(width, 1e-6)
            name, cut = np.zeros(width, int), np.full(width, np.inf)
            local = node - (width - 1)
            gs, hs = np.bincount(local, g, width), np.bincount(local, h, width)
            for j, limit in enumerate(limits):
                if not len(limit):
                    continue
                key = local * (len(limit) + 1) + binned[:, j]
                gl = np.bincount(key, g, width * (len(limit) + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1]
                hl = np.bincount(key, h, width * (len(limit) + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1]
                gain = gl**2 / (hl + ridge) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + ridge) - (gs**2 / (hs + ridge))[:, None]
                best = gain.argmax(axis=1)
                value = gain[np.arange(width), best]
                better = value > gain_best
                gain_best[better], name[better], cut[better] = value[better], j, limit[best[better]]
            names += name.tolist()
            cuts += cut.tolist()
            node = 2 * node + 1 + (x[np.arange(len(y)), name[local]] > cut[local])
        local = node - ((1 << DEPTH) - 1)
        value = rate * np.bincount(local, g, 1 << DEPTH) / (np.bincount(local, h, 1 << DEPTH) + ridge)
        total += value[local]
        splits.append((names, cuts))
        leaves.append(value.tolist())
    return Trees(base, splits, leaves)


def decode(page: Page, odds) -> list[bool]:
    """Content or not for each element: the best labelling in which a path goes outside, content, excluded and never back."""
    n = len(page.tags)
    size = [0] * n
    for i, _, text in page.runs:
        size[i] += len(text)
    gain = [float(odds[i]) * (NODE + math.log1p(size[i])) for i in range(n)]
    outside, content, excluded = [-g for g in gain], list(gain), [-g for g in gain]
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        excluded[p] += excluded[i]
        content[p] += max(content[i], excluded[i])
        outside[p] += max(outside[i], content[i], excluded[i])
    state = [0] * n
    for i in range(1, n):
        above = state[page.parents[i]]
        if above == 2:
            state[i] = 2
        elif above == 1:
            state[i] = 1 if content[i] >= excluded[i] else 2
        else:
            best = max(outside[i], content[i], excluded[i])
            state[i] = 1 if content[i] == best else 0 if outside[i] == best else 2
    return [s == 1 for s in state]


def text_of_page(page: Page, kept: list[bool]) -> str:
    """The blocks of the kept elements in page order: references decoded, white space to one space, trimmed, joined by line feeds."""
    blocks: dict[int, list[str]] = {}
    for i, block, text in page.runs:
        if kept[i]:
            blocks.setdefault(block, []).append(text)
    found = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(b for b in found if b)


# Forms of boilerplate to graft ({a} {b} {c}: words), and containers of the article.
GRAFTS = (
    '<aside class="sidebar"><h3>{a}</h3><p>{b}</p></aside>', '<div class="sidebar"><ul><li>{a}</li><li>{b}</li></ul><p>{c}</p></div>', '<div id="side"><p>{b}</p></div>', "<aside><p>{c}</p></aside>",
    '<aside><h4>{a}</h4><ul><li><a href="/e">{a}</a></li><li><a href="/h">{b}</a></li></ul></aside>', "<aside><ul><li>{a}</li><li>{b}</li></ul></aside>", "<aside><h3>{a}</h3><p>{b}</p><blockquote>{b}</blockquote></aside>", '<aside><h4>{a}</h4><ul><li><a href="/e">{a}</a></li></ul></aside>',
    '<div class="cookie-notice"><p>{b}</p><button>{a}</button></div>', '<div class="notice">{c}</div>', '<section class="alert"><p>{b}</p></section>', '<div id="gdpr-consent">{b}</div>', '<p class="notice">{b}</p>', '<div role="alert">{b}</div>',
    '<section id="comments"><h2>{a}</h2><div class="comment"><p>{b}</p></div><div class="comment"><p>{c}</p></div></section>', '<div class="comments"><p>{c}</p><p>{b}</p></div>', '<ol class="commentlist"><li><p>{b}</p></li><li><p>{c}</p></li></ol>', '<div class="user-comment">{b}</div>', '<div class="replies"><blockquote>{c}</blockquote></div>',
    '<form action="/s"><label>{a}</label><input name="q"><button>{a}</button></form>', '<form class="newsletter"><p>{b}</p><select><option>{a}</option><option>{a}</option></select></form>', '<div class="login-form"><label>{a}</label><p>{b}</p></div>',
    '<div class="ad">{b}</div>', '<div class="advert"><p>{c}</p></div>', '<ins class="adsbygoogle">{a}</ins>', '<div class="sponsored"><a href="/x">{b}</a></div>', '<aside class="promo">{b}</aside>', '<div id="ad-top"><b>{b}</b></div>', '<p class="advertisement">{b}</p>',
    '<div class="share"><ul><li><a href="/f">{a}</a></li><li><a href="/g">{a}</a></li></ul></div>', '<nav class="breadcrumb"><a href="/">{a}</a> <a href="/b">{a}</a></nav>', '<nav><ul><li><a href="/n">{a}</a></li></ul></nav>', '<div class="menu"><a href="/q">{a}</a><a href="/r">{a}</a></div>', '<ul class="nav"><li><a href="/k">{a}</a></li></ul>',
    '<header><div class="logo">{a}</div><p>{b}</p></header>', '<div class="header"><p>{b}</p></div>', '<div id="header">{a}</div>', '<footer><p>{b}</p></footer>', '<div class="footer">{c}</div>', '<div id="page-footer"><p>{b}</p><a href="/z">{a}</a></div>',
    '<div class="related-posts"><h4>{a}</h4><ul><li><a href="/u">{b}</a></li><li><a href="/v">{b}</a></li></ul></div>', '<div class="pagination"><a href="?p=2">{a}</a></div>', '<div class="subscribe"><p>{b}</p></div>', '<div class="widget"><h3>{a}</h3><p>{c}</p></div>', '<p class="copyright">{b}</p>', '<div class="popup modal"><p>{b}</p></div>',
    "<nav>{a}</nav>", "<nav>{d}</nav>", "<nav><p>{a}</p></nav>", '<nav><a href="/c">{a}</a></nav>', "<nav><span>{a}</span> <span>{a}</span></nav>", "<footer>{a}</footer>", "<footer>{d}</footer>", "<footer><span>{d}</span></footer>", "<aside>{a}</aside>", "<aside>{d}</aside>", "<button>{a}</button>", '<button type="button">{d}</button>', "<form>{a}<button>{a}</button></form>",
    '<div role="navigation">{a}</div>', '<div role="navigation"><a href="/d">{a}</a> <a href="/e">{a}</a></div>', '<ul role="navigation"><li>{a}</li><li>{d}</li></ul>', '<div role="contentinfo">{d}</div>', '<div role="contentinfo"><p>{b}</p></div>', '<section role="contentinfo">{a}</section>', '<div role="complementary">{a}</div>', '<div role="complementary"><p>{b}</p></div>', '<div role="banner">{d}</div>', '<div role="search">{a}</div>', '<section role="complementary"><h3>{a}</h3><p>{b}</p></section>',
)
#: Bare boilerplate before and after the article of a short page.
SHORT_BEFORE = ("<nav>{a}</nav>", "<nav>{d}</nav>", "<header>{a}</header>", "<header>{d}</header><nav>{a}</nav>", '<nav><a href="/">{a}</a></nav>', '<nav><ul><li><a href="/">{d}</a></li><li><a href="/n">{d}</a></li></ul></nav>', '<div role="navigation">{a}</div>', '<div role="banner">{d}</div>', '<div class="menu">{a}</div>', "")
SHORT_AFTER = ("<footer>{a}</footer>", "<footer>{d}</footer>", "<footer><p>{a}</p></footer>", '<div role="contentinfo">{a}</div>', '<div role="contentinfo">{d}</div>', '<div role="complementary">{a}</div>', "<aside>{a}</aside><footer>{d}</footer>", '<div class="footer">{a}</div>', '<section id="comments"><h2>{d}</h2><p>{a}</p></section><footer>{d}</footer>', '<form><input name="q"><button>{d}</button></form>', "")
#: Its article: what stands before, between and after paragraphs of one to five words.
SHORT_HEADS = ("<h1>{a}</h1>", "<h1>{d}</h1>", "<header><h1>{d}</h1></header>", "", "<h2>{a}</h2>")
CONTENT = (
    "<ul><li>{a}</li><li>{b}</li><li>{a}</li></ul>", "<ol><li>{b}</li><li>{c}</li></ol>", "<ol><li><p>{b}</p></li><li><p>{c}</p></li></ol>", '<ul class="list"><li>{a}</li><li><a href="/w">{a}</a> {b}</li><li>{b}</li></ul>', "<ul><li><b>{a}</b> {b}</li><li>{b}</li></ul>",
    "<table><tr><th>{a}</th><th>{a}</th></tr><tr><td>{a}</td><td>{b}</td></tr></table>", "<table><caption>{a}</caption><tbody><tr><td>{b}</td><td>{a}</td></tr><tr><td>{a}</td><td>{b}</td></tr></tbody></table>", '<table class="data"><thead><tr><th>{a}</th></tr></thead><tbody><tr><td>{b}</td></tr></tbody></table>',
    "<blockquote>{b}</blockquote>", "<blockquote><p>{c}</p></blockquote>", "<blockquote><p>{b}</p><cite>{a}</cite></blockquote>", "<pre>{b}</pre>", "<pre><code>{b}</code></pre>", '<figure><img src="/i.png"><figcaption>{b}</figcaption></figure>', "<figure><figcaption>{a}</figcaption></figure>",
    "<dl><dt>{a}</dt><dd>{b}</dd><dt>{a}</dt><dd>{c}</dd></dl>", "<div>{b}</div>", "<div><p>{b}</p></div>", "<div><div><p>{b}</p><p>{c}</p></div></div>", '<div class="row"><p>{c}</p></div>', "<section><h2>{a}</h2><p>{c}</p></section>", "<section><h3>{a}</h3><p>{b}</p><ul><li>{b}</li><li>{a}</li></ul></section>",
    "<h2>{a}</h2>", "<h3>{a}</h3><p>{b}</p>", "<p>{a}</p>", "<p><em>{a}</em></p>", "<p><span>{b}</span></p>", '<p class="lead">{b}</p>', '<p><a href="/y">{a}</a> {b}</p>', "<details><summary>{a}</summary><p>{b}</p></details>",
)
HEADS = ("<header><h1>{a}</h1></header>", "<header><h1>{a}</h1><p>{b}</p></header>", "<h1>{a}</h1>", "<hgroup><h1>{a}</h1><p>{a}</p></hgroup>")
CONTAINERS = ("article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry"', 'section class="story"', 'div class="article-text"', 'div itemprop="articleBody"', "div", 'article class="post"', 'div role="main"')
#: Forms that an article's paragraphs take as a whole: before, each, after.
FORMS = (
    ("<ol>", "<li>{}</li>", "</ol>"), ("<ul>", "<li>{}</li>", "</ul>"), ("<ol>", "<li><p>{}</p></li>", "</ol>"), ("<table>", "<tr><td>{}</td></tr>", "</table>"), ("", "<div>{}</div>", ""), ("<div>", "<p>{}</p>", "</div>"),
    ("<blockquote>", "<p>{}</p>", "</blockquote>"), ("<dl>", "<dd>{}</dd>", "</dl>"), ("", "<blockquote>{}</blockquote>", ""), ("", "<pre>{}</pre>", ""), ("<section>", "<p>{}</p>", "</section>"), ("", "{}<br><br>", ""),
)
PARAGRAPH = re.compile(r"<p>(.*?)</p>", re.S)


def augmented(source: str, words: list[str], rng: random.Random) -> str:
    """The page with boilerplate grafted in (marked data-x-label 0), content grafted into its article, whose paragraphs may take another form, and the
    article's container (marked 1) renamed."""
    def some(lo: int, hi: int) -> str:
        at = rng.randrange(max(1, len(words) - hi))
        return html.escape(" ".join(words[at : at + rng.randint(lo, hi)]))

    def filled(forms: tuple[str, ...]) -> str:
        return rng.choice(forms).format(a=some(1, 4), b=some(5, 40), c=some(10, 80), d=some(1, 1))

    def graft() -> str:
        return re.sub(r"^<(\w+)", r"<\1 data-x-label=0", filled(GRAFTS))

    def maybe(share: float, make) -> str:
        return make() if rng.random() < share else ""

    def content() -> str:
        return filled(CONTENT)

    inside = re.search(r"<(article|main)\b[^>]*>(.*?)</\1>", source, re.S)
    if not inside:
        return re.sub(r"</p>(?=<p)", lambda m: m[0] + maybe(0.08, graft), source)
    box, body = rng.choice(CONTAINERS), inside[2]
    first = PARAGRAPH.search(body)
    if first and rng.random() < 0.25:
        before, each, after = rng.choice(FORMS)
        last = body.rindex("</p>") + 4
        body = body[: first.start()] + before + PARAGRAPH.sub(lambda m: each.format(m[1]), body[first.start() : last]) + after + body[last:]
    if rng.random() < 0.3:
        body = re.sub(r"<h1>.*?</h1>", "", body, count=1, flags=re.S)
        body = f"{re.sub(r'^<(header|hgroup)', r'<\1 data-x-label=1', filled(HEADS))}{maybe(0.3, graft)}{body}"
    body = re.sub(r"</(?:p|li|div)>(?=<(?:p|li|div)>)", lambda m: m[0] + (maybe(0.12, content) + maybe(0.08, graft) if m[0] == "</p>" else ""), body)
    body = f"{maybe(0.15, graft)}{body}{maybe(0.3, content)}{maybe(0.2, graft)}"
    whole = f"{maybe(0.6, graft)}<{box} data-x-label=1>{body}</{box.split()[0]}>{maybe(0.6, graft)}{maybe(0.3, graft)}"
    # Some pages are cut down to a bare fragment.
    return whole if rng.random() < 0.06 else f"{source[: inside.start()]}{whole}{source[inside.end() :]}"


def short_page(words: list[str], rng: random.Random) -> str:
    """A page of few blocks: an article of paragraphs, most of one to five words, bare boilerplate beside and within it, labelled as in ``augmented``; some are the article alone."""
    def filled(forms: tuple[str, ...]) -> str:
        a, d = (" ".join(rng.choices(words, k=n)) for n in (rng.randint(1, 5), 1))
        return rng.choice(forms).format(a=html.escape(a), d=html.escape(d), b=html.escape(" ".join(rng.choices(words, k=rng.randint(3, 12)))), c=html.escape(a))

    def bare(forms: tuple[str, ...]) -> str:
        return re.sub(r"<(nav|header|footer|aside|div|section|form|button)\b", r"<\1 data-x-label=0", filled(forms))

    box = rng.choice(CONTAINERS)
    head = re.sub("^<header", "<header data-x-label=1", filled(SHORT_HEADS))
    longest = rng.choice([5, 5, 5, 20, 120])
    parts = [f"<p>{html.escape(' '.join(rng.choices(words, k=rng.randint(1, longest))).capitalize())}{rng.choice(['.', '.', '', '!'])}</p>" for _ in range(rng.randint(0 if head else 1, 4))]
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
        parts.insert(rng.randint(0, len(parts)), bare(GRAFTS))
    if rng.random() < 0.25:
        parts.append(bare(("<button>{a}</button>", "<button>{d}</button>", '<button type="button">{d}</button>', "<form>{a}<button>{d}</button></form>")))
    inside = f"<{box} data-x-label=1>{head}{''.join(parts)}</{box.split()[0]}>"
    return inside if rng.random() < 0.12 else f"<html><body>{bare(SHORT_BEFORE)}{inside}{bare(SHORT_AFTER)}</body></html>"


def labels(page: Page) -> list[int]:
    """1 for elements of the article: below an article, main or marked container and below no boilerplate element or graft."""
    found = [0] * len(page.tags)
    for i in range(1, len(page.tags)):
        tag, attributes, above = page.tags[i], page.attributes[i], found[page.parents[i]]
        if above == -1 or "data-x-label=0" in attributes:
            found[i] = -1
        elif "data-x-label=1" in attributes:
            found[i] = 1
        elif tag in ("nav", "footer", "header", "aside", "form"):
            found[i] = -1
        elif above == 1 or tag in ("article", "main"):
            found[i] = 1
    return [max(0, f) for f in found]


def fit(pages: DataFrame, column: str = "html", sample_pages: int = 120, chars: int = 30_000, copies: int = 5, short: int = 8, seed: int = 5) -> Trees:
    """Trees fitted to at most ``sample_pages`` pages, the least by a hash of their id, of which ``chars`` characters serve,
    with ``copies`` of each that have grafts and ``short`` pages of a few of its words.

    The pages are picked by ids and hashes alone, so whole pages never gather. Null pages and ids don't serve. Without a page that has an article
    (an empty table, for one), pages of the grafts alone serve.
    """
    import numpy as np

    given = pages.where(F.col(column).isNotNull() & F.col("page_id").isNotNull())
    keyed = given.select(F.xxhash64("page_id").alias("_a"), F.xxhash64(column).alias("_b"), F.left(column, F.lit(chars)).alias("_h"))
    picked = keyed.select("_a", "_b").orderBy("_a", "_b").limit(sample_pages)
    rows = {(r["_a"], r["_b"]): r for r in keyed.join(F.broadcast(picked), ["_a", "_b"], "left_semi").limit(4 * sample_pages).collect()}
    rows = [rows[k] for k in sorted(rows)]
    sources = [r["_h"] for r in rows if re.search(r"<(article|main)\b", r["_h"])]
    rng, filler = random.Random(seed), "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    if not sources:
        sources = [f"<html><body><nav><a href=/>{' '.join(filler[:3])}</a></nav><article><h1>{' '.join(filler)}</h1>{('<p>' + ' '.join(filler * 3) + '.</p>') * n}</article><footer>{filler[0]}</footer></body></html>" for n in range(1, 30)]
    words = [w for s in sources[:40] for w in re.sub(r"<[^>]*>|&\w+;", " ", s).split()] or filler
    xs, ys, ws = [], [], []
    for source in sources:
        for copy in range(copies + 1 + short):
            page = parse(source if not copy else augmented(source, words, rng) if copy <= copies else short_page(words, rng))
            x, size = features(page), np.zeros(len(page.tags))
            for i, _, text in page.runs:
                size[i] += len(text)
            xs.append(x)
            ys.append(np.array(labels(page), float))
            ws.append(NODE_FIT + np.log1p(size))
    return boost(np.vstack(xs), np.concatenate(ys), np.concatenate(ws))


def extract(pages: DataFrame, trees: Trees, column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page, from the whole html.

    A null or empty page, and one without an article, has an empty text; a very long page is parsed whole, in time that grows with its
    length. Repeated rows are extracted one by one, an empty table gives no rows, and columns other than page_id, url and the html are left
    out, whatever their names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                parsed = [parse(source) for source in part.column(2).to_pylist()]
                rows = [features(page) for page in parsed]
                odds = np.split(trees.odds(np.vstack(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = [text_of_page(page, decode(page, o)) for page, o in zip(parsed, odds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages[column], F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
