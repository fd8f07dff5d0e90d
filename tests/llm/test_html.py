import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from corpusward.llm import html
from corpusward.llm.html import Page


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("plain &amp; simple\n\n text", "plain & simple text"),
        ("<body><p>a<b>b</b> c<p>d<ul><li>x<li>y &amp z</ul><table><tr><td>1<td>2<tr><td>3</table>tail <i>x</i></body>", "ab c\nd\nx\ny & z\n1\n2\n3\ntail x"),
        ("<p>one<br>two &#233;&eacute;&nbsp;&lt;b&gt;</p>", "one two éé <b>"),
        ("<nav>n</nav><header>h</header><div class='sidebar-left'>s</div><div class='ad'>a</div><p>kept</p><footer>f</footer>", "kept"),
        ("<p>kept</p><form>f<input>g</form><div id='cookie-notice'>c</div><div role=navigation>m</div><div hidden>h</div><section class='comments'><p>c</p></section>", "kept"),
        ("<script>var t='<p>x</p>';</script><style>p{}</style><!-- <p>no</p> --><p>kept</p><script>open", "kept"),
        ("<div>out</div><article><h1>T</h1><p>in <b>x<br><p>next</p><aside>no</aside></article><div>out</div>", "T\nin x\nnext"),
        ("<article>unclosed <p>end", "unclosed\nend"),
        ("a < b <> c </ d <1", "a < b <> c </ d <1"),
        ("<div class='loaded'>a</div><div class='reading'>b</div>", "a\nb"),
        ("<p title='a>b'>q</p><P CLASS=Ad>no</P>", "q"),
        ("<article><p>a<!-- b --!>c</p><p>d<!-->e<!--->f<!---->g<!-- > -- -->h</p>i<!-- open --", "ac\ndefgh\ni"),
    ],
)
def test_pages(source, want):
    assert Page(source).text() == want


def test_site_templates(spark):
    rows = [(i, f"http://a.example/{i}", f"<div><p>Welcome to our site</p><p>all about it</p></div><p>story {i}</p>") for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", f"<article><p>shared passage</p><p>own {i}</p></article>") for i in range(8)]
    rows += [(40 + i, None, "<p>same</p>") for i in range(8)] + [(60, "http://c.example/", None), (61, "http://c.example/", ""), (None, "http://c.example/", "<p>x</p>"), (62, "no scheme", "<p>y</p>")]
    rows += [(70 + i, "http://d.example/", "<p>few pages</p>") for i in range(4)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, template string")
    got = {(r.page_id, r.url): r.text for r in html.main_text(pages).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i, f"http://a.example/{i}"] == f"story {i}"
        assert got[20 + i, f"http://b.example/{i}"] == f"shared passage\nown {i}"
        assert got[40 + i, None] == "same"
    assert got[60, "http://c.example/"] == got[61, "http://c.example/"] == "" and got[None, "http://c.example/"] == "x" and got[62, "no scheme"] == "y"
    assert got[70, "http://d.example/"] == "few pages"
    assert html.main_text(pages.limit(0)).collect() == []


def test_long_pages_and_depth():
    assert Page("<div>" * 3000 + "deep").text() == "deep"
    assert len(Page("<p>word</p>" * 20_000).text()) == 5 * 20_000 - 1


def test_large_hosts_are_dealt_out(spark):
    rows = [(i, "http://a.example/", f"<div><p>site</p></div><p>story {i}</p>") for i in range(900)] + [(1000 + i, None, f"<p>{i}</p>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert len(got) == 1200 and all(got[i] == f"story {i}" for i in range(900)) and all(got[1000 + i] == str(i) for i in range(300))


def test_templates_inside_articles(spark):
    def page(url, i, html):
        return (i, f"http://{url}/{i}", html)

    bar = "<div><p>Share this</p><ul><li>one</li><li>two</li></ul></div>"
    rows = [page("m.example", i, f"<div><main><div><p>Our notice</p></div><h1>T {i}</h1><p>story {i}</p></main></div>") for i in range(8)]
    rows += [page("r.example", 10 + i, f"<article><p>shared passage</p><p>own {i}</p>{bar}</article>") for i in range(8)]
    # copies of a page, under another advert each, make no template of its article
    rows += [page("c.example", 20 + i, f"<div class='ad'>{i}</div><div><article><h1>T</h1><div><p>whole story</p></div></article></div>") for i in range(8)]
    # nothing else in the article
    rows += [page("o.example", 30 + i, f"<article>{bar}</article><p>{i}</p>") for i in range(8)]
    # on 40 % of a large host's pages
    rows += [page("l.example", 100 + i, f"<main>{bar if i % 5 < 2 else ''}<p>text {i}</p></main>") for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    for i in range(8):
        assert got[i] == f"T {i}\nstory {i}"
        assert got[10 + i] == f"shared passage\nown {i}"
        assert got[20 + i] == "T\nwhole story"
        assert got[30 + i] == "Share this\none\ntwo"
    assert all(got[100 + i] == f"text {i}" for i in range(100))


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article class='post has-sidebar'><h2 class='entry-header'>T</h2><p class='share-price'>up</p></article>", "T\nup"),
        ("<main id='content' class='no-header'><p>in</p></main>", "in"),
        ("<div class='with-menu'><p>around</p></div>", "around"),
        ("<div class='sidebar'><p>out</p><main><p>in</p><div class='ad'>a</div></main></div>", "in"),
        ("<article class='promo'><p>in</p></article>", "in"),
        ("<article><p>in</p></article><div class='comments'><article><p>said</p></article></div><article class='comment' id='comment-12'>said</article>", "in"),
        ("<main><article class='sponsored'><p>in</p></article><div id='comments'><article class=x>said</article></div></main>", "in"),
        ("<div class='comments'><aside><article>aside</article></aside><p>kept out</p></div><p>kept</p>", "kept"),
        ("<div class='site-header'>h</div><ul class='main-nav'><li>n</ul><div class='post share-buttons'>s</div><div class='ad__slot'>a</div><p>kept</p>", "kept"),
    ],
)
def test_class_words(source, want):
    assert Page(source).text() == want


@pytest.mark.parametrize(
    "source, want",
    [
        ('<p title="the hidden gem">kept</p><p data-x="see class=ad here">too</p><p title="class=ad">and</p>', "kept\ntoo\nand"),
        ('<p title="x>unclosed</p><p>next</p>', "unclosed\nnext"),
        ("<p title=5\">q</p><p a'b class=ad>no</p><p class = 'ad' x>no</p><p CLASS=\"ad\" class=ok>no</p>", "q"),
        ('<div id="story"><p>A long story, told by and by.</p></div><article class="card"><p>A teaser</p></article>', "A long story, told by and by."),
        ('<div id="story"><p>A long story, told by and by, at great length.</p></div><article><p>A teaser</p></article>', "A long story, told by and by, at great length."),
        ("<article class='teaser card'><p>Another story, longer than this one</p></article><article><p>This story</p></article>", "This story"),
        ("<main><ol class='crumbs'><li>Home</li></ol><div>Date</div><article><h1>T</h1><p>text of the story</p></article></main>", "T\ntext of the story"),
        ("<main><p>The story itself is here, and long.</p><article><p>Also</p></article></main>", "The story itself is here, and long."),
        ("<article><p>one</p></article><article><p>two</p></article>", "one\ntwo"),
        ("<nav><article><p>out</p></article></nav><p>kept</p>", "kept"),
        ("<p>kept</p><!-- open <p>no</p>", "kept"),
        ("<table><tr><td>a<b>b</td><td>c</b>d</table>", "ab\ncd"),
        ("<p>a<span class=ad>no <b>nor</b></span> b<button>c</button></p>", "a b"),
    ],
)
def test_attributes_and_parts(source, want):
    assert Page(source).text() == want


BROKEN = {
    "open tags": "<a", "open tags, closed at last": "<a<p", "quotes": '<a href="', "other quotes": "<p title='x\">", "nested": "<div><li><td><b>", "ends": "</x></div></b>",
    "inline under a table": "<i></b>", "signs": "<", "comments": "<!--", "references": "&amp&", "items": "<li>x", "articles": "<article>x", "blanks": "<a ", "declarations": "<!x <?",
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_markup_takes_linear_time(name):
    def seconds(n):
        source = ("<b><table>" if "table" in name else "") + BROKEN[name] * n
        best = 1e9
        for _ in range(2):
            began = time.process_time()
            Page(source + (">" if "last" in name else "")).text()
            best = min(best, time.process_time() - began)
        return best

    assert seconds(40_000) < 6 * seconds(10_000) + 0.3
    assert seconds(10_000) < 2


def _tree(source):
    """(tag, class, children) of a page whose tags are all closed, by the standard library's parser."""

    class Builder(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack = [("root", "", [])]

        def handle_starttag(self, tag, attrs):
            node = (tag, dict(attrs).get("class", ""), [])
            self.stack[-1][2].append(node)
            self.stack.append(node)

        def handle_endtag(self, tag):
            assert self.stack.pop()[0] == tag

        def handle_data(self, data):
            self.stack[-1][2].append(data)

    builder = Builder()
    builder.feed(source)
    builder.close()
    return builder.stack[0]


def _key(node):
    return node if isinstance(node, str) else (node[0], tuple(_key(x) for x in node[2]))


def _holds_article(node):
    return not isinstance(node, str) and (node[0] == "article" or any(map(_holds_article, node[2])))


def _walk(node, in_article=False, above=()):
    """(node, in an article, the nodes above it) of all elements."""
    for child in node[2]:
        if not isinstance(child, str):
            yield child, in_article, (*above, node)
            yield from _walk(child, in_article or child[0] == "article", (*above, node))


def _brute(pages):
    """url: the text of each page; leaves of these pages hold one text each."""
    by_host, trees = {}, {}
    for url, source in pages:
        tree = trees[url] = _tree(source)
        counts = by_host.setdefault(url.split("/")[2], Counter())
        counts.update({_key(x) for x, inside, _ in _walk(tree) if not _holds_article(x) and not (inside and x[0] in html.PROSE)})
        counts["pages"] += 1
    out = {}
    for url, tree in trees.items():
        counts, lines = by_host[url.split("/")[2]], []
        for x, inside, above in _walk(tree):
            n, whole = counts[_key(x)], counts["pages"]
            recurs = lambda y, at: not _holds_article(y) and not (at and y[0] in html.PROSE) and (counts[_key(y)] >= max(5, whole / 2) or counts[_key(y)] >= max(20, whole / 100))  # noqa: E731, B023
            path = [*above[1:], x]
            inner = [False] * len(path)
            for k in range(1, len(path)):
                inner[k] = inner[k - 1] or path[k - 1][0] == "article"
            gone = any(recurs(y, at) for y, at in zip(path, inner)) or any(y[0] in ("nav", "footer") or y[1] == "ad" for y in path)
            if not gone and inside and x[2] and isinstance(x[2][0], str):
                lines.append(x[2][0])
        out[url] = "\n".join(lines)
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(n)) for _ in range(3))
    rows = []
    for host, n in (("a.example", 400), ("b.example", 60), ("c.example", 9), ("d.example", 3)):
        navs, bars = [f"<ul><li>{say(99)}</li><li>{say(99)}</li></ul>" for _ in range(8)], [f"<div><p>{say(9)}</p></div>" for _ in range(4)]
        boxes = [f"<section><div><p>{say(9)}</p></div></section>" for _ in range(12)]
        shared = f"<p>{say(9)}</p>"
        for i in range(n):
            body = "".join(rng.choice([f"<p>{say(999)}</p>", f"<p>{say(999)}</p>", shared, rng.choice(bars), rng.choice(boxes), f"<ul><li>{say(9)}</li></ul>"]) for _ in range(6))
            top = rng.choice([f"<nav>{rng.choice(navs)}</nav>", f"<div>{rng.choice(navs)}</div>", ""])
            rows.append((f"http://{host}/{i}", f"<html><body>{top}<div class='ad'>{say(9)}</div><div><article><h1>{say(9999)} {i}</h1><p>{i} {say(999)} {say(999)}</p>{body}</article></div><footer>{rng.choice(bars)}</footer></body></html>"))
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    want = _brute(rows)
    for most_broadcast in (500_000, 0):
        got = {r.url: r for r in html.main_text(pages, most_broadcast=most_broadcast).collect()}
        assert {u: r.text for u, r in got.items()} == want
    plain = {u: Page(h).text() for u, h in rows}
    assert sum(plain[u] != t for u, t in want.items()) > 100 and sum(r.n_template > 0 for r in got.values()) > 300


def test_templates_of_the_given_pages(spark):
    """Navigation, adverts and footers of the given pages recur on their hosts: the counts alone find
    them, whether or not a tag or class tells. (A menu stands on ten pages of the largest host here.)"""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url like '%://blog.tionsh.example.com%'")
    rows = pages.select("html", F.lit("blog.tionsh.example.com").alias("host"))
    found = {h for r in html.templates(rows, many=8).collect() for h in r.template}
    changed = 0
    for r in rows.collect():
        page = Page(r.html)
        bare, kept = page.text(marks=False), page.text(found, marks=False)
        changed += bare != kept
        assert page.text(found) == page.text() and page.text() in kept  # the article itself stays
    assert changed > 50
