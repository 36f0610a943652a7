"""Main text of web pages by tree scoring.

Tags build a light tree.  Every text block passes points, for its length and
its commas, to its ancestors with falling weight, discounted by its share of
link text; the container with the most points, again discounted by its link
density, is taken, or the ``article`` or ``main`` around it, together with
siblings that score well or are paragraphs of their own.  Menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are left out
by element, role and the words of class and id.

Pages are independent rows: no shuffle, and memory is bounded by one page
and its tree.

Defined results: null or empty html, and a page without text, give an empty
string; text outside any tag counts as a block of the page; a page that ends
inside a tag, comment, script or style loses that rest; repeated rows are
treated alike; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_values

BATCH_BYTES = 8 << 20
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = re.compile(r"</(script|style|title|textarea|noscript|template|xmp|iframe)\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template xmp iframe".split())
SKIP = frozenset("head nav header footer aside form button select option menu dialog svg math object canvas audio video map datalist fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
#: Start tags before which an open paragraph ends.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"}
#: An open element of the key ends when one of the same family starts, up to the boundary.
FAMILIES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of a class or id that name what is not the article.
NOT_ARTICLE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side|rail|widget\w*|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead"
    r"|comments?|commentlist|respond|reply|replies|disqus\w*|cookies?\w*|consent|notices?|notification\w*|alerts?|popup\w*|modal|overlay|newsletter\w*|subscribe\w*|signup"
    r"|login|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|gdpr|paywall|form|search|hidden)(?:$|[-_\s\d])",
    re.I,
)
#: Those of them that as often name something in an article (side-effects, search-results), and words for parts of a page.
OFTEN_ELSE = frozenset("side rail search form hidden alert alerts login toolbar respond reply".split())
PARTS = frozenset("area bar block body bottom box button col column container content field group icon inline inner input item items label left link links list main module nav outer pane panel row right section title top widget wrap wrapper".split())
#: Mean letters of a link below which a list of links is a menu.
MENU_LINK = 20
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _left_out(tag: str, raw: str) -> bool:
    if tag in SKIP:
        return True
    if not raw or tag in ("html", "body"):
        return False
    attrs = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(raw)}
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    named = _CAMEL.sub("-", f"{attrs.get('class', '')} {attrs.get('id', '')}")
    return bool(named.strip() and NOT_ARTICLE.search(named)) and any(_names_no_article(name) for name in named.lower().split())


def _names_no_article(name: str) -> bool:
    """Whether one class is a name of what is not the article: words with other meanings count only beside words for a part of a page."""
    words = [w for w in re.split(r"[-_\d]+", name) if w]
    named = [w for w in words if NOT_ARTICLE.search(w)]
    return any(w not in OFTEN_ELSE for w in named) or bool(named) and all(w in OFTEN_ELSE or w in PARTS for w in words)


class _Page:
    """The tree of one page and its text blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out = ["#page"], [-1], [False]
        self.blocks: list[tuple[str, int, int, int]] = []  # text, characters in links, links, node
        self._stack, self._text, self._linked, self._links, self._begun = [0], [], 0, 0, 0
        self._open: dict[str, int] = {"#page": 1}  # open elements of each name
        self._held = [0]  # open blocks
        self._read(source)

    def _put(self, text: str) -> None:
        if text and not self.out[self._stack[-1]]:
            text = _html.unescape(text)
            self._text.append(text)
            if self._links:
                self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self._text:
            words = "".join(self._text).split()
            if words:
                self.blocks.append((" ".join(words), self._linked, self._begun, self._held[-1]))
            self._text, self._linked, self._begun = [], 0, 0

    def _close(self, depth: int) -> None:
        """Close open elements down to ``depth`` of the stack."""
        for node in self._stack[depth:]:
            self._open[self.tag[node]] -= 1
            self._links -= self.tag[node] == "a"
        blocks = sum(self.tag[n] in BLOCKS for n in self._stack[depth:])
        if blocks:
            self._flush()
            del self._held[-blocks:]
        del self._stack[depth:]

    def _open_at(self, names: frozenset, stop: frozenset) -> int | None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in names:
                return depth
            if tag in stop:
                return None
        return None

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        find = _TOKEN.search
        while at < n:
            m = find(source, at)
            if m is None:
                self._put(source[at:])
                break
            self._put(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "br":
                    self._put(" ")
                elif self._open.get(tag):
                    depth = self._open_at(frozenset([tag]), frozenset() if tag in BLOCKS else BLOCKS)
                    if depth is not None:
                        self._close(depth)
                    elif tag in BLOCKS:
                        self._flush()
                elif tag in BLOCKS:
                    self._flush()
                continue
            if tag in ("br", "wbr"):
                self._put(" " if tag == "br" else "")
                continue
            if tag in RAW:
                end = _RAW.search(source, at)
                while end and end[1].lower() != tag:
                    end = _RAW.search(source, end.end())
                if not end:
                    break
                close = source.find(">", end.end())
                at = close + 1 if close >= 0 else n
                continue
            if tag in ENDS_P and self._open.get("p"):
                depth = self._open_at(frozenset(["p"]), frozenset(["table", "td", "th", "button"]))
                if depth is not None:
                    self._close(depth)
            if tag in FAMILIES and any(self._open.get(t) for t in FAMILIES[tag][0]):
                depth = self._open_at(*FAMILIES[tag])
                if depth is not None:
                    self._close(depth)
            if tag in BLOCKS:
                self._flush()
            if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
                continue
            above = self._stack[-1]
            self.tag.append(tag)
            self.parent.append(above)
            self.out.append(self.out[above] or _left_out(tag, m[3]))
            self._stack.append(len(self.tag) - 1)
            if tag in BLOCKS:
                self._held.append(len(self.tag) - 1)
            self._open[tag] = self._open.get(tag, 0) + 1
            self._links += tag == "a"
            self._begun += tag == "a"
        self._flush()


def main_text(source: str) -> str:
    """The article of one page, its blocks joined by line ends."""
    page = _Page(source)
    tag, parent, blocks = page.tag, page.parent, page.blocks
    if not blocks:
        return ""
    points, text, linked, begun = [0.0] * len(tag), [0] * len(tag), [0] * len(tag), [0] * len(tag)
    for words, links, starts, node in blocks:
        size = len(words)
        text[node] += size
        linked[node] += links
        begun[node] += starts
        if size < 25:
            continue
        score = (1 + words.count(",") + words.count("，") + min(size / 100, 3)) * (1 - min(1.0, links / size))
        up, level = (parent[node] if tag[node] in PARAGRAPHS else node), 0
        while up >= 0 and level < 5:
            points[up] += score / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = parent[up], level + 1
    for n in range(len(tag) - 1, 0, -1):  # children come behind their parents
        text[parent[n]] += text[n]
        linked[parent[n]] += linked[n]
        begun[parent[n]] += begun[n]
    density = lambda n: min(1.0, linked[n] / text[n]) if text[n] else 0.0
    final = [p * (1 - density(n)) for n, p in enumerate(points)]
    best = max(range(len(final)), key=lambda n: (final[n], -n))
    if final[best] <= 0:
        return "\n".join(words for words, links, _, _ in blocks if links * 2 <= len(words))
    up = best
    while up > 0:
        if tag[up] in ("article", "main"):
            best = up
            if tag[up] == "article":
                break
        up = parent[up]
    kept = {best}
    bar = max(10.0, 0.2 * final[best])
    if tag[best] == "article":  # an article in several parts, but not its teasers
        kept |= {n for n in range(1, len(tag)) if parent[n] == parent[best] and tag[n] == "article" and final[n] >= 0.3 * final[best] and density(n) < 0.25}
    elif tag[best] != "main" and best:
        for n in range(1, len(tag)):
            if parent[n] != parent[best] or n == best or not text[n]:
                continue
            if final[n] >= bar or tag[n] in PARAGRAPHS and density(n) < 0.25:
                kept.add(n)
    inside: dict[int, bool] = {-1: False}

    def within(n: int) -> bool:
        path = []
        while n not in inside:
            # A list of several links of a few letters each is a menu wherever it stands; references have longer ones.
            if n not in kept and tag[n] in ("ul", "ol", "div", "section", "table", "dl") and density(n) > 0.8 and begun[n] > 1 and linked[n] < MENU_LINK * begun[n]:
                inside[n] = False
            elif n in kept:
                inside[n] = True
            else:
                path.append(n)
                n = parent[n]
        found = inside[n]
        for x in path:
            inside[x] = found
        return found

    # Loose text beside the paragraphs of the best container's parent counts as a sibling too.
    loose = parent[best] if tag[best] not in ("article", "main") else -2
    return "\n".join(words for words, links, _, node in blocks if within(node) or node == loose and len(words) >= 25 and links * 4 < len(words))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", BATCH_BYTES):
            texts = [main_text((h or b"").decode("utf-8", "replace")) for h in utf8_values(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    return base.mapInArrow(run, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars bigint")
