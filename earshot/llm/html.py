"""Main text of web pages by composite text density."""

from __future__ import annotations

import bisect
import html
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import python_batches, unused

# Fixed values of HTML: elements without content, with raw content, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html head legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
#: Tags that an element of this name ends if one is open, up to the tags where the search stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody"), ("table",)), "option": (("option",), ("select",)),
}
#: Parts of a page that are never its article: by tag, by role, and by a word of class or id.
OUT_TAGS = frozenset("nav aside footer form button select option label input svg canvas object audio video map menu dialog search head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup paywall comment comments commentlist disqus respond replies sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "share sharing social related recommended recommendations widget widgets pagination pager login copyright disclaimer skip discussion responses announcement announcements "
    "notification notifications aside rail trending".split()
)
#: Beginnings of such words, as they are also written together with others.
OUT_STARTS = ("cookie", "advert", "sidebar", "newsletter", "popup", "sponsor", "breadcrumb", "commentlist", "commentform", "commentsection", "commentsarea", "navbar", "adbanner", "adslot")
#: Those of the words that an article's own sections are also named by.
SECTION_WORDS = frozenset(
    "notice notices alert promotion promotions related recommended recommendations social share sharing discussion responses replies respond announcement announcements notification notifications "
    "navigation advertising subscription copyright disclaimer menu trending rail banner overlay header head".split()
)
#: Those of them that also name prose; the others name boxes, unless the part has a heading of its own.
PROSE_WORDS = frozenset("related discussion responses replies respond head header".split())
#: Elements whose class or id does not put them out, and those that may be the article's own heading.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT = frozenset("html body main article p".split()) | HEADINGS
HEADER_WORDS = frozenset(("header", "head"))
#: Elements that end what is open as blocks do, but begin no block.
CELLS = frozenset(("td", "th"))
#: Names of elements that hold an article.
HOLDERS = frozenset("article main".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
_OPEN_END = re.compile(r"<!--.*\Z|<!\[CDATA\[.*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What a reader's comment says of itself beside its author: a date, a time, an age, a way to answer.
_SAID = re.compile(r"\b(?:19|20)\d\d\b|\b\d{1,2}[:.]\d\d\b|\b(?:ago|says|said|wrote|reply|yesterday|today)\b", re.I)
#: Most characters of a comment's author; elements that lists of comments are made of.
AUTHOR, COMMENT_TAGS = 60, frozenset("div li article section dd".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Open:
    """The open elements. Where the last one of a name, or the last block, is found at once, so that any end tag, also
    one of many without a begin, costs no more than what it closes."""

    def __init__(self):
        self.nodes, self.names, self.blocks = [0], ["#"], []
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, name: str) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.names.append(name)
        self.places.setdefault(name, []).append(place)
        if name in BLOCK or name in CELLS:
            self.blocks.append(place)

    def last(self, names) -> int:
        """The place of the last open element of one of these names; 0 without any."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def last_block(self, but: str | None = None) -> int:
        i = len(self.blocks) - 1
        while i >= 0 and self.names[self.blocks[i]] == but:
            i -= 1
        return self.blocks[i] if i >= 0 else 0

    def cut(self, place: int) -> None:
        """Closes the element at this place and all in it."""
        while len(self.nodes) > place:
            at = len(self.nodes) - 1
            self.nodes.pop()
            self.places[self.names.pop()].pop()
            if self.blocks and self.blocks[-1] == at:
                self.blocks.pop()


class _Page:
    """Nodes in page order, so that a subtree is a range; node 0 is the root. pieces: (node, text), text None: a new block."""

    def __init__(self, source: str, by_words: bool = True):
        self.tag, self.parent, self.out, self.pieces = ["#"], [-1], [False], []
        self.by_words, self.open = by_words, _Open()
        stack = self.open
        at, find, last = 0, _TAG.search, source.rfind(">")
        while True:
            # After the last > only an open comment, declaration or CDATA section can begin something.
            m = find(source, at) if at <= last else _OPEN_END.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                self.pieces.append((stack.nodes[-1], html.unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5]) if m.re is _TAG else None
            if not name:
                if m[0].startswith("<![CDATA["):
                    self.pieces.append((stack.nodes[-1], m[0][9:].removesuffix("]]>")))
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._end(name)
                continue
            self._begin(name, m[3] or "")
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                self.out[-1] = True
                stack.cut(len(stack.nodes) - 1)
            elif name in VOID:
                self.pieces.append((self.parent[-1], " "))
                stack.cut(len(stack.nodes) - 1)

    def _begin(self, name: str, attributes: str) -> None:
        stack = self.open
        if name in ENDS:
            ends, stop = ENDS[name]
            place = stack.last(ends)
            if place > stack.last(stop):
                stack.cut(place)
        if name in BLOCK:  # a block ends an open paragraph, and what is open inside it
            place = stack.last(("p",))
            if place > stack.last_block(but="p"):
                stack.cut(place)
        if name in ("body", "html") and stack.last((name,)):
            name = "span"
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(stack.nodes[-1])
        self.out.append(self._is_out(name, attributes, self.by_words))
        stack.push(node, name)
        if name in BLOCK:
            self.pieces.append((node, None))
        elif name in CELLS:
            self.pieces.append((node, " "))

    def _end(self, name: str) -> None:
        stack = self.open
        place = stack.last((name,))
        inline = name not in BLOCK and name not in CELLS
        if not place or inline and place < stack.last_block():
            return
        if name in BLOCK:
            self.pieces.append((self.parent[stack.nodes[place]], None))
        stack.cut(place)

    @staticmethod
    def _is_out(name: str, attributes: str, by_words: bool):
        """True: out whatever it holds. 1: out unless it holds the article or its heading. 2: or is a section of text.
        3: as 2, named like a box.

        by_words False: words of class and id count for nothing."""
        if name in OUT_TAGS:
            return True
        found = 1 if name == "header" else False
        if not attributes:
            return found
        words: set[str] = set()
        classes: list[str] = []
        for m in _ATTR.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                found_words = [w.lower() for w in _NAME.findall(value)]
                words.update(found_words)
                if key == "class":
                    classes += found_words
            elif key == "role" and value.lower() in OUT_ROLES:
                found = 1
            elif key == "style" and _HIDDEN.search(value) or key == "aria-hidden" and value.lower() == "true":
                return True
        if re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*'|\S+)", "", attributes)):
            return True
        if not by_words:
            return found
        if name not in KEPT and (words & OUT_WORDS or words & HEADER_WORDS or any(w.startswith(OUT_STARTS) for w in words)):
            named = words & (OUT_WORDS | HEADER_WORDS)
            clear = named - SECTION_WORDS or any(w.startswith(OUT_STARTS) for w in words) or found
            by_class = name != "section" and len(classes) > 1 and named & set(classes)
            return 1 if clear or by_class else 2 if named <= PROSE_WORDS else 3
        return 1 if name == "article" and words & {"comment", "comments", "reply"} else found


def _like_comments(p: _Page, part: int, end: list[int], children: list[list[int]], words: list[tuple[int, int, str]]) -> bool:
    """Whether a part is a list of two or more like elements that mostly begin with a short name and tell when it was said.

    words: (node, place in the page, text) of the part by node, without blanks."""
    at = part
    while True:
        kids = [c for c in children[at] if p.tag[c] not in HEADINGS]
        if len(kids) != 1:
            break
        at = kids[0]
    for name in COMMENT_TAGS:
        like = [c for c in kids if p.tag[c] == name]
        told = 0
        for c in like:
            own = words[bisect.bisect_left(words, (c,)) : bisect.bisect_left(words, (end[c],))]
            said = [t for _, t in sorted((place, t) for _, place, t in own)]
            told += len(said) > 1 and len(said[0]) <= AUTHOR and ("time" in p.tag[c : end[c]] or any(_SAID.search(x) for x in said[:3] if len(x) <= AUTHOR))
        if told > 1 and 2 * told >= len(like):
            return True
    return False


def _sections(p: _Page, end: list[int], holds: list[bool]) -> set[int]:
    """Nodes named like a part that is no article (2, 3) which are sections of text all the same.

    No more than half of its characters are in links, and it has more than half of the page's; or it begins not before
    the page's one h1 and has as much text as half of a usual paragraph (the median of those outside such parts) and a
    heading of its own, or, if its name is not a box's, two paragraphs or more, on average as long as that. A list of
    readers' comments is none if there are other paragraphs (asked of outermost parts, so that the work stays linear).
    """
    n = len(p.tag)
    gone, named = [False] * n, [False] * n  # in what is out whatever it holds; in what has such a name
    children: list[list[int]] = [[] for _ in range(n)]
    link, sums = [False] * n, [[0] * (n + 1) for _ in range(6)]
    for i in range(1, n):
        up = p.parent[i]
        gone[i] = p.out[i] is True or gone[up]
        named[i] = p.out[i] in (1, 2, 3) and not holds[i] or named[up]
        link[i] = p.tag[i] == "a" or link[up]
        sums[2][i + 1] = p.tag[i] in HEADINGS
        children[up].append(i)
    heading, paragraph = [False] * n, [0] * n
    for i in range(1, n):
        heading[i] = p.tag[i] in HEADINGS or heading[p.parent[i]]
        paragraph[i] = i if p.tag[i] == "p" else paragraph[p.parent[i]]
    texts = sorted((i, place, t) for place, (i, x) in enumerate(p.pieces) if x and not gone[i] and (t := x.strip()))
    for i, _, t in texts:
        sums[0][i + 1] += len(t)
        sums[1][i + 1] += len(t) * link[i]
        sums[3][i + 1] += len(t) * heading[i]
        sums[4][i + 1] += len(t) * (paragraph[i] > 0)
        sums[5][paragraph[i] + 1] = int(paragraph[i] > 0)
    totals = [list(itertools.accumulate(x)) for x in sums]

    def chars(i: int, k: int = 0) -> int:
        return totals[k][end[i]] - totals[k][i]

    lengths = sorted(chars(i) for i in range(1, n) if p.tag[i] == "p" and not gone[i] and not named[i] and chars(i))
    usual = lengths[len(lengths) // 2] if lengths else 0
    half = (totals[0][n] - totals[1][n]) / 2
    titles = [i for i in range(1, n) if p.tag[i] == "h1" and not gone[i]]
    title = titles[0] if len(titles) == 1 else 0
    found: set[int] = set()
    inside = 0  # end of the last part asked for comments
    for i in range(1, n):
        if p.out[i] not in (2, 3) or gone[i] or not chars(i) or 2 * chars(i, 1) > chars(i):
            continue
        if usual and i >= inside:
            inside = end[i]
            if _like_comments(p, i, end, children, texts[bisect.bisect_left(texts, (i,)) : bisect.bisect_left(texts, (end[i],))]):
                continue
        if chars(i) - chars(i, 1) > half:
            found.add(i)
        elif end[i] > title and 2 * (chars(i) - chars(i, 3)) >= usual:
            if chars(i, 2) or p.out[i] == 2 and chars(i, 5) > 1 and 2 * chars(i, 4) >= usual * chars(i, 5):
                found.add(i)
    return found


def _main_nodes(p: _Page) -> tuple[list[bool], list[tuple[int, int]]]:
    """Which nodes are left out, and the ranges of nodes that hold the main text."""
    n, parent, tag = len(p.tag), p.parent, p.tag
    end = list(range(1, n + 1))
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        if tag[i] in ("h1", "main") or tag[i] == "article" and not p.out[i] or holds[i]:
            holds[parent[i]] = True
        if end[i] > end[parent[i]]:
            end[parent[i]] = end[i]
    out = [False] * n
    texts = _sections(p, end, holds) if 2 in p.out or 3 in p.out else ()
    for i in range(1, n):
        out[i] = out[parent[i]] or p.out[i] is True or (p.out[i] in (1, 2, 3) and not holds[i] and i not in texts)

    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for i, text in p.pieces:
        if text and not out[i]:
            chars[i] += len(text) - text.count(" ") if text.isspace() else len(text.strip())
    link = [False] * n
    for i in range(1, n):
        link[i] = tag[i] == "a" or link[parent[i]]
    for i in range(n - 1, 0, -1):
        if out[i]:
            continue
        if link[i]:
            link_chars[i], link_tags[i] = chars[i], tags[i] + (tag[i] == "a")
        up = parent[i]
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i]
    body = next((i for i in range(1, n) if tag[i] == "body"), 0)
    share = link_chars[body] / chars[body] if chars[body] else 0.0

    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c = chars[i]
        if c and not out[i]:
            lc, t = link_chars[i], max(1, tags[i])
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, link_tags[i]))) / max(1.0, math.log(base))
        if i:
            sums[parent[i]] += density[i]
    candidates = [i for i in range(body, end[body]) if not out[i]]
    best = max(candidates, key=lambda i: (sums[i], density[i], -i))
    if not sums[best]:
        return out, [(body, end[body])]

    def path(i: int) -> list[int]:
        up = [i]
        while up[-1] != body and up[-1] > 0:
            up.append(parent[up[-1]])
        return up

    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parent[i]].append(i)

    def as_dense(up: int) -> list[int]:
        return [i for i in children[up] if i != top and not out[i] and tag[i] in BLOCK and density[i] >= threshold and chars[i] > 2 * link_chars[i]]

    threshold = min(density[i] for i in path(best))
    holders = [i for i in path(best) if tag[i] in HOLDERS]
    if holders:  # the outermost article, or else main
        articles = [i for i in holders if tag[i] == "article"]
        top = (articles or holders)[-1]
        return out, [(top, end[top])]
    top = best
    while top != body:  # sections beside the best one that are as dense as its path to the body
        up = parent[top]
        if up == body or not as_dense(up):
            break
        top = up
    if tag[top] in ("p", "b", "i", "em", "strong", "span", "blockquote", "li", "ul", "ol") and parent[top] > 0 and top != body:
        top = parent[top]
    ranges = [(top, end[top])]
    if top != body and parent[top] == body:
        ranges += [(i, end[i]) for i in as_dense(body)]
    titles = [i for i in range(body, end[body]) if tag[i] == "h1" and not out[i] and chars[i] > 2 * link_chars[i]]
    if len(titles) == 1 and not any(a <= titles[0] < b for a, b in ranges):  # the page's heading, where it stands apart
        ranges.append((titles[0], end[titles[0]]))
    return out, sorted(ranges)


def main_text(source: str | None) -> str:
    """Main text of a page's whole html: its blocks in page order, one a line; "" if there is none.

    What is never an article (by tag, role, or a word of class or id) is left out first, unless it holds the page's
    heading or article; headings and paragraphs never go by a word, and a section of text, or what has most of the
    page's text, not by one that an article's own sections have, too. Where nothing is left, words count for nothing. Each node's density is its characters per tag, lowered by the share of links; the subtree whose
    children's densities have the largest sum is the main one. The least density on its path to the body is the
    threshold for sections beside it; an enclosing article or main element is taken whole. The page's one h1 is added.
    """
    if not source or source.isspace():
        return ""
    page = _Page(source)
    text = _text(page)
    if not text and any(type(x) is int for x in page.out):
        text = _text(_Page(source, by_words=False))
    return text


def _text(p: _Page) -> str:
    out, ranges = _main_nodes(p)
    inside = [False] * len(p.tag)
    for a, b in ranges:
        inside[a:b] = [True] * (b - a)
    blocks, now = [], []
    for i, text in p.pieces:
        if text is None:
            blocks.append(now)
            now = []
        elif inside[i] and not out[i]:
            now.append(text)
    blocks.append(now)
    lines = (" ".join("".join(b).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (code points of text); columns of these names are replaced.

    Null, empty and tagless html give what there is: "" or the text itself. Every page is handled alone, whole, so rows
    may repeat; an empty table stays empty.
    """
    python_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    (source,) = unused(pages, "source_")
    slim = pages.select(*rest, F.col(html_col).alias(source))
    fields = [f"`{c}` {t}" for c, t in slim.select(*rest).dtypes] + ["text string", "n_chars long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    return slim.mapInArrow(run, ", ".join(fields))
