"""Main text of web pages, with removal of site templates.

Subtrees of every page are hashed and counted by host in Spark; a subtree that recurs on many pages
of its host is a part of the site's template and is deleted, wherever it stands. Only prose inside an
<article> (PROSE: paragraphs, headings, quotes, single items and cells) stays if it recurs, as
passages that articles share are no template; containers of it, such as lists and divisions, go.

Of the rest, markup decides: elements that are menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or reader comments by their tag, role, class or id go, and where a page marks
its article or main part, the text is the nearest such part's that holds the page's prose.

A page is cut into tags and texts in one pass whose work is linear in its length, however broken its
markup is; a stack of open elements follows the nesting, with the usual implied ends.
"""

from __future__ import annotations

import html
import re
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.shared import cut, left_join_spread
from corpusward.llm.urls import url_host

_NAME = re.compile(r"/?+[a-zA-Z][^\s/>]*+")
#: The rest of a tag. Quotes only count after =; one that never closes is an ordinary character.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_MARKING = frozenset("class id role hidden aria-hidden".split())

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_COMMENT_END = re.compile(r"(?<=<!)---?>|(?<!<!)--!?>")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag ends, up to the nearest element of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements that are no part of a text.
DROPPED = frozenset("head script style noscript template title nav header footer aside form button select textarea input iframe object svg canvas audio video map menu dialog search noembed noframes xmp datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
#: Words in class or id that mark such elements.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond reply replies pagination pager toolbar widget skip".split()
)
#: Words that stand beside them in a class or id without another meaning, as in sidebar-left or site-header.
BESIDE = frozenset("left right top bottom main primary secondary site global mobile desktop sticky fixed small large list area box bar block container wrapper wrap inner outer item items link links button buttons icon icons form text section unit slot media google posts articles stories".split())
#: Words that mark an article as a teaser of another page, and as a reader's comment.
TEASER_WORDS = frozenset("teaser card preview excerpt related recommended promo".split())
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
ARTICLE = frozenset(("article", "main"))
#: Blocks that are an article's own words, even if other articles have them too.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figcaption summary li dt dd tr td th tbody thead tfoot".split())
#: Elements that are no template as a whole.
_WHOLE = ARTICLE | {"html", "body", "head"}
#: Elements out of which an end tag of an inline element doesn't reach.
_CELLS = ("td", "th", "table")
#: Elements whose words are a page's prose.
_STORY = frozenset("p pre blockquote li dd".split())
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _marks(value: str, words: frozenset) -> bool:
    """Whether a class or id holds a token that says one of these words and nothing else."""
    for token in value.split():
        pieces = [x for x in re.split(r"[^a-z0-9]+", token) if x and not x.isdigit()]
        if not words.isdisjoint(pieces) and all(x in DROPPED_WORDS or x in BESIDE or x in words for x in pieces):
            return True
    return False


def attributes(source: str) -> dict[str, str]:
    """The attributes that may mark an element, small letters, the first of each name."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in _MARKING and name not in found:
            found[name] = html.unescape(value.strip("\"'")).lower()
    return found


class _Open:
    __slots__ = ("tag", "dropped", "by_word", "said", "region", "own_prose", "parts", "first_block", "words", "holds_article")

    def __init__(self, tag, dropped, by_word, said, region, own_prose, first_block):
        self.tag, self.dropped, self.by_word, self.said, self.region, self.own_prose, self.first_block = tag, dropped, by_word, said, region, own_prose, first_block
        self.parts, self.words, self.holds_article = [], False, False


class Page:
    """A page's blocks of text, its articles, and its subtrees that may belong to a template.

    blocks: (text, region, dropped by a mark, in a prose element). regions: (parent, doubt) of the
    page itself (0) and each article or main part; doubt is 1 for teasers, 2 for comments and what
    stands in an element that a class word drops. subtrees: (hash, first block, block after the last)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self.regions: list[tuple[int, int]] = [(0, 0)]
        self.subtrees: list[tuple[int, int, int]] = []
        self._text: list[str] = []
        self._stack = [_Open("", False, False, True, 0, False, 0)]
        self._at: dict[str, list[int]] = {}  # where in the stack the elements of a tag are
        self._other_blocks = [0]  # and the blocks other than p
        at, n, last = 0, len(source), source.rfind(">")
        while at < n:
            if source[at] != "<":
                stop = source.find("<", at)
                stop = n if stop < 0 else stop
                self._say(source[at:stop])
                at = stop
                continue
            after = source[at + 1 : at + 2]
            if after == "!" or after == "?":
                at = self._declaration(source, at)
                continue
            named = _NAME.match(source, at + 1) if at < last else None
            if not named:
                self._say("<")
                at += 1
                continue
            rest = _REST.match(source, named.end())
            end = rest.end() if rest else source.find(">", at) + 1
            tag = named.group().lower()
            at = end
            if tag[0] == "/":
                self._end(tag[1:])
                continue
            self._begin(tag, source[named.end() : end - 1])
            if tag in RAW:
                close = _CLOSING[tag].search(source, at)
                stop = close.start() if close else n
                if tag == "textarea" or tag == "title":
                    self._say(source[at:stop])
                at = stop
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    @staticmethod
    def _declaration(source: str, at: int) -> int:
        """The place after a comment, a CDATA section or a declaration; without an end, the page's end."""
        if source.startswith("<!--", at):
            stop = _COMMENT_END.search(source, at + 2)  # <!--> and <!---> are whole comments
            return stop.end() if stop else len(source)
        for begin, end in (("<![CDATA[", "]]>"), ("<", ">")):
            if source.startswith(begin, at):
                stop = source.find(end, at + len(begin))
                return len(source) if stop < 0 else stop + len(end)
        return at + 1

    def _say(self, raw: str) -> None:
        top = self._stack[-1]
        top.parts.append(" ".join(raw.split()))
        if top.parts[-1]:
            top.words = True
        if top.said:
            self._text.append(raw)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                top = self._stack[-1]
                story = any(len(self._at.get(t, ())) for t in _STORY)
                self.blocks.append((text, top.region, top.dropped, story))
            self._text = []

    def _last(self, tags) -> int:
        """Where in the stack the last element of these tags is; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=0)

    def _dropped_by(self, tag: str, marks: dict[str, str]) -> str:
        """'tag' (or a role, or hidden), 'word' (in class or id), or empty. An article is not dropped by
        its own class, unless that makes it a comment."""
        if tag in DROPPED:
            return "tag"
        if not marks or tag in ("body", "html"):
            return ""
        if "hidden" in marks or marks.get("aria-hidden") == "true" or marks.get("role") in DROPPED_ROLES:
            return "tag"
        words = COMMENT_WORDS if tag in ARTICLE else DROPPED_WORDS
        return "word" if any(_marks(marks[x], words) for x in ("class", "id") if x in marks) else ""

    def _begin(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if (p := self._last(("p",))) > self._other_blocks[-1]:  # a block ends an open paragraph, and what it holds
                self._close(p)
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            if (k := min((at[-1] for t in ends if (at := self._at.get(t)) and at[-1] > self._last(within)), default=0)):
                self._close(k)
        top = self._stack[-1]
        if tag in VOID:
            if tag == "br" and top.said:
                self._text.append(" ")
            top.parts.append(f"<{tag}>")
            return
        marks = attributes(rest) if "=" in rest or "hidden" in rest.lower() else {}
        by = self._dropped_by(tag, marks)
        dropped, by_word, region = top.dropped or by != "", top.by_word if top.dropped else by == "word", top.region
        if by == "tag":
            by_word = False
        elif tag in ARTICLE:
            teaser = any(_marks(marks[x], TEASER_WORDS) for x in ("class", "id") if x in marks)
            doubt = 2 if by_word else 1 if teaser and tag == "article" else 0
            if by_word or not dropped:
                dropped, by_word, region = False, False, len(self.regions)
                self.regions.append((top.region, doubt))
        said = not dropped or tag in BLOCKS if top.said else not dropped
        if dropped != top.dropped and tag in BLOCKS:
            self._flush()
        self._at.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCKS and tag != "p":
            self._other_blocks.append(len(self._stack))
        self._stack.append(_Open(tag, dropped, by_word, said, region, top.own_prose or tag == "article", len(self.blocks)))

    def _close(self, k: int) -> None:
        while len(self._stack) > k:
            self._pop()

    def _end(self, tag: str) -> None:
        if tag == "br":
            if self._stack[-1].said:
                self._text.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
        k = self._last((tag,))
        if k and (tag in BLOCKS or tag in _CELLS or k > self._last(_CELLS)):
            self._close(k)

    def _pop(self) -> None:
        x = self._stack[-1]
        if x.tag in BLOCKS:
            self._flush()
        self._stack.pop()
        self._at[x.tag].pop()
        if self._other_blocks[-1] == len(self._stack) > 0:
            self._other_blocks.pop()
        subtree = xxhash.xxh64_intdigest("\x1f".join((x.tag, *x.parts)))
        above = self._stack[-1]
        above.parts.append(f"\x1e{subtree}")  # a parent's hash is made of its children's; texts have no such sign
        if x.words:
            above.words = True
        if x.holds_article or x.tag in ARTICLE:
            above.holds_article = True
        elif x.first_block < len(self.blocks) and x.tag in BLOCKS and x.tag not in _WHOLE and not (x.own_prose and x.tag in PROSE):
            self.subtrees.append((subtree - (1 << 63), x.first_block, len(self.blocks)))

    def in_template(self, template: frozenset | set) -> list[bool]:
        """Which blocks stand in a subtree whose hash is in template."""
        out = [False] * len(self.blocks)
        for h, low, high in self.subtrees:
            if h in template:
                out[low:high] = [True] * (high - low)
        return out

    def _chosen(self) -> list[int]:
        """The page's main blocks by its marks alone. From the page down: where the articles in a part
        hold at least a third of its prose (the words of paragraphs and the like, or all words if
        there are none), they are chosen and looked into; else the part's own blocks are."""
        own: list[list[int]] = [[] for _ in self.regions]
        inside: list[list[int]] = [[] for _ in self.regions]
        for k in range(1, len(self.regions)):
            inside[self.regions[k][0]].append(k)
        for i, (_, region, dropped, _) in enumerate(self.blocks):
            if not dropped:
                own[region].append(i)
        size = [[0, 0] for _ in self.regions]
        for k in range(len(self.regions) - 1, -1, -1):  # a part comes after the one it stands in
            size[k][0] += sum(len(self.blocks[i][0]) for i in own[k] if self.blocks[i][3])
            size[k][1] += sum(len(self.blocks[i][0]) for i in own[k])
            if k:
                for j in (0, 1):
                    size[self.regions[k][0]][j] += size[k][j] if self.regions[k][1] < 2 or j else 0
        chosen, parts = [], [0]
        while parts:
            k = parts.pop()
            within = [x for x in inside[k] if size[x][1]]
            least = min((self.regions[x][1] for x in within), default=0)
            within = [x for x in within if self.regions[x][1] == least]
            j = 0 if any(self.blocks[i][3] for x in (k, *within) for i in own[x]) else 1
            mine = sum(len(self.blocks[i][0]) for i in own[k] if j or self.blocks[i][3])
            if within and 2 * sum(size[x][1 if least == 2 else j] for x in within) >= mine:
                parts += within
            else:
                chosen += own[k]
        return sorted(chosen)

    def text(self, template: frozenset | set = frozenset(), marks: bool = True) -> str:
        """The page's main text without the subtrees whose hashes are in template. A part of a page
        marked as its article of which nothing would be left stays whole. Without marks, only the
        template is left out."""
        gone = self.in_template(template)
        chosen = self._chosen() if marks else range(len(self.blocks))
        left = [i for i in chosen if not gone[i]]
        if not left and marks and any(self.blocks[i][1] for i in chosen):
            left = chosen
        return "\n".join(self.blocks[i][0] for i in left)


def _subtree_batches(batches):
    """host, hash of a subtree, hash of the page's text; and one row of each page with a null subtree."""
    for batch in batches:
        hosts, hashes, texts = [], [], []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(source)
            some = [None, *{h for h, *_ in page.subtrees}]
            hosts += [host] * len(some)
            hashes += some
            texts += [xxhash.xxh64_intdigest(page.text()) - (1 << 63)] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(texts, pa.int64())], ["host", "hash", "text"])


def _text_batches(batches):
    for batch in batches:
        texts, removed = [], []
        for source, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
            page, template = Page(source), set(template or ())
            texts.append(page.text(template))
            removed.append(sum(len(page.blocks[i][0]) for i, gone in enumerate(page.in_template(template)) if gone) if template else 0)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["page_id", "url", "text", "n_template"])


def templates(rows: DataFrame, share: float = 0.5, least: int = 5, many: int = 20, few: float = 0.01) -> DataFrame:
    """host, template: the hashes of subtrees that stand on `share` of the host's pages, and on
    `least` of them; or on `many`, if these are `few` of its pages. Pages of one text count once, so
    that copies of a page make no template of it. A host has no more templates than its mean page
    has subtrees, divided by few."""
    rows = rows.where("host <> ''")
    found = rows.select("host", "html").mapInArrow(_subtree_batches, "host string, hash long, text long").distinct()
    counts = cut(found.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= min(least, many))))
    pages = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    enough = lambda n, part: (F.col("n") >= n) & (F.col("n") >= part * F.col("pages"))
    often = counts.where("hash is not null").join(pages, "host").where(enough(least, share) | enough(many, few))
    return often.groupBy("host").agg(F.collect_list("hash").alias("template"))


def main_text(pages: DataFrame, share: float = 0.5, least: int = 5, most_broadcast: int = 500_000) -> DataFrame:
    """page_id, url, text and n_template of each page: its blocks in order, each with white space made
    one space, joined by newlines; and the characters that its site's template held.

    A null or empty html has an empty text. Pages without a host (a null url too) have no site, so
    only markup decides there. Repeated rows come out repeated and count as one page of their site; no
    rows give no rows; other columns play no part. Broken markup takes no more time than whole.

    Templates of up to most_broadcast subtrees in all are broadcast, and pages stay where they are;
    with more, pages are joined by host, and those of a large host dealt to many tasks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), url_host(F.col("url").cast("string")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = cut(templates(rows, share, least))
    n = found.agg(F.sum(F.size("template"))).first()[0] or 0
    if n <= most_broadcast:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        joined = left_join_spread(rows, found, "host", rows.groupBy("host").agg(F.count("*").alias("n")), rows.count())
    return joined.select("page_id", "url", "html", "template").mapInArrow(_text_batches, "page_id long, url string, text string, n_template long")
