"""Main-text extraction by scoring the element tree.

Paragraphs give points for their length and commas to their ancestors, fewer
the farther; an element's score is discounted by the share of its text within
links.  The element with the best score is the container; where it lies in an
article or main element, the nearest of these is.  It is kept together with
those of its siblings that score or read like part of the article, and with
headings, lists, tables, short paragraphs and bare text between or beside these, unless
much of them is links.  Menus,
page headers and footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are cut out of the tree beforehand, by element, role, or a
name of class or id that consists of words for furniture alone; words that an
article may be about don't count on elements that hold an article's mark (its heading, element or name),
nor on a page that has no paragraph elsewhere.

Pages are read in time and memory in proportion to their length, however deep
elements are nested.

Defined results: null and empty html give an empty text; html without markup is
one paragraph; unclosed and stray tags are repaired; a tag that the page's end
cuts off is dropped; repeated rows get equal
texts; other columns pass through, and those named like an added one are
replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.session import bound_batches

_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no article text.
_CHROME = set("nav footer aside form button select option datalist dialog menu head svg math canvas audio video object applet map input label fieldset".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "tablist", "status"}
#: Words that mark page furniture where a name of class or id consists of them and of common ones.
_FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification notifications popup modal overlay lightbox newsletter subscribe subscription signup signin login register "
    "paywall sidebar sidebars aside rail widget widgets related recommended recommendations trending share sharing social "
    "comment comments commentlist usercomments disqus respond reply replies discussion footer foot masthead nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager toolbar skip search searchbox searchform header topbar tagcloud shoutbox outbrain taboola disclaimer legal copyright".split()
)
#: Those that are as well names of things that articles have or are about.
_DOUBTFUL = set("header banner banners legal disclaimer discussion reply replies respond notice notices aside widget widgets promo promotion skip search share sharing social related register foot rail overlay".split())
#: Words that say nothing beside one that marks furniture.
_COMMON = set(
    "the my our site page global top bottom left right upper lower main inner outer primary secondary box block blocks list lists wrap wrapper container area areas section "
    "bar bars panel panels zone slot unit item items row col column link links icon icons button buttons btn form forms group holder region module modules content text "
    "js id fixed sticky mobile desktop user users reader thread media posts articles stories news us this here footer header".split()
)
_OWN = {"article", "entry", "story", "post"}
_MARKS = {"article", "content", "entry", "story", "post", "hentry"}
_ARTICLE = set("article content entry post story main body text hentry page column".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}}
_PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd"}
_SPACES = re.compile(r"\s+")
_MIN_POINTS_CHARS = 25
_GAP, _NAME, _EQUALS, _BARE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_ITEMS = _CLOSED_BY.keys() | set().union(*_SCOPES.values())


class Node:
    """An element: kids are nodes and texts in page order; block and item are the nearest such elements, itself included."""

    __slots__ = ("block", "chars", "commas", "drop", "inside", "item", "kids", "linked", "marked", "names", "own", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, names: tuple = (), drop: bool = False):
        self.tag, self.parent, self.kids, self.score, self.names, self.drop = tag, parent, [], 0.0, names, drop
        self.block = self if parent is None or tag in _BLOCK else parent.block
        self.item = self if tag in _ITEMS else parent and parent.item
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.own = self.chars = self.commas = self.linked = 0
        self.marked = False


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """The attributes of a tag from the end of its name on, whether a slash ends it, and where it ends; -1 where the page does before."""
    found: list[tuple[str, str]] = []
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= len(page):
            return found, False, -1
        if page[at] == ">":
            return found, gap[0].endswith("/"), at + 1
        name = _NAME.match(page, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, False, -1
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.append((name[0].lower(), value))


def _named(attributes: list[tuple[str, str]]) -> tuple[tuple, bool]:
    """The names of class and id, each as its words, and whether the attributes alone make the element furniture."""
    names: list[tuple] = []
    drop = False
    for name, value in attributes:
        if name in ("class", "id"):
            for one in value.split():
                names.append(tuple(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", one).lower())))
        elif name == "role":
            drop |= value.strip().lower() in _ROLES
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            drop = True
        elif name == "style":
            drop |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return tuple(names), drop


class Tree:
    """Builds the element tree from tags and texts; every step is bounded, but for elements that it closes."""

    def __init__(self):
        self.root = self.node = Node("html", None)
        self.nodes = [self.root]
        self.open: list[dict] = [{}]  # elements open by tag, within each open article or table
        self.blocks: dict[str, int] = {}  # block elements open

    def text(self, piece: str) -> None:
        if piece:
            self.node.kids.append(html_lib.unescape(piece) if "&" in piece else piece)

    def close_to(self, parent: Node) -> None:
        """Close all that is open below ``parent``."""
        while self.node is not parent:
            tag = self.node.tag
            if tag in ("article", "table"):
                self.open.pop()
            self.open[-1][tag] -= 1
            if tag in _BLOCK:
                self.blocks[tag] -= 1
            self.node = self.node.parent

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            if not self.blocks.get(tag):
                return
        elif not self.open[-1].get(tag):
            return
        up = self.node
        while up.tag != tag:
            up = up.parent
        self.close_to(up.parent)

    def start(self, tag: str, attributes: list[tuple[str, str]], slash: bool) -> None:
        if tag in _BLOCK and self.node.block.tag == "p":  # an open paragraph ends where a block begins, with what is open in it
            self.close_to(self.node.block.parent)
        if tag in _CLOSED_BY:
            up, scope = self.node.item, _SCOPES.get(tag, set())
            while up is not None and up.tag not in scope:
                if up.tag in _CLOSED_BY[tag]:
                    self.close_to(up.parent)
                up = up.parent and up.parent.item
        fresh = Node(tag, self.node, *_named(attributes))
        self.node.kids.append(fresh)
        self.nodes.append(fresh)
        if tag not in _VOID and (not slash or tag in _BLOCK):  # a slash doesn't close blocks
            self.node = fresh
            self.open[-1][tag] = self.open[-1].get(tag, 0) + 1
            if tag in _BLOCK:
                self.blocks[tag] = self.blocks.get(tag, 0) + 1
            if tag in ("article", "table"):
                self.open.append({})


def parse(page: str) -> list[Node]:
    """The page's elements in page order, the root first, without raw elements, comments and declarations.

    Tags are read by the rules of HTML for names and quoted and bare values, in
    one pass; a tag, comment or raw element that the page's end cuts off is dropped.
    """
    tree, at = Tree(), 0
    while (mark := page.find("<", at)) >= 0:
        if page.startswith("<!--", mark):
            tree.text(page[at:mark])
            at = mark + 5 if page.startswith(">", mark + 4) else mark + 6 if page.startswith("->", mark + 4) else -1
            if at < 0:
                end = page.find("-->", mark + 4)
                at = end + 3 if end >= 0 else len(page)
        elif page.startswith("<![CDATA[", mark):
            tree.text(page[at:mark])
            end = page.find("]]>", mark)
            tree.text(page[mark + 9 : end if end >= 0 else len(page)])
            at = end + 3 if end >= 0 else len(page)
        elif page[mark + 1 : mark + 2] in ("!", "?"):
            tree.text(page[at:mark])
            end = page.find(">", mark)
            at = end + 1 if end >= 0 else len(page)
        elif m := _TAG.match(page, mark + 1):
            tree.text(page[at:mark])
            attributes, slash, at = _attributes(page, m.end())
            if at < 0:
                return tree.nodes
            tag = m[2].lower()
            if tag in ("html", "body"):
                continue
            if m[1]:
                tree.end(tag)
            elif tag in _RAW:
                if not slash:
                    end = _RAW_END[tag].search(page, at)
                    at = end.start() if end else len(page)
            else:
                tree.start(tag, attributes, slash)
        else:
            tree.text(page[at : mark + 1])
            at = mark + 1
    tree.text(page[at:])
    return tree.nodes


def _counted(nodes: list[Node]) -> None:
    """Characters, commas and linked characters of every element; in reverse page order all below an element comes before it."""
    for node in nodes:
        node.own = node.chars = node.commas = node.linked = 0
        node.marked = False
    for node in reversed(nodes):
        for k in node.kids:
            if isinstance(k, str):
                node.own += len(k.strip())
                node.commas += k.count(",")
        node.chars += node.own
        if node.tag == "a":
            node.linked = node.chars
        if (up := node.parent) is not None:
            up.chars, up.commas, up.linked = up.chars + node.chars, up.commas + node.commas, up.linked + node.linked
            up.marked |= node.marked or node.tag in ("article", "main", "h1") or any(w in _MARKS for words in node.names for w in words)


def _is_furniture(node: Node, doubtful: bool) -> bool:
    if node.drop or node.tag in _CHROME:
        return True
    if node.tag == "header" and not node.parent.inside:
        return True
    if node.tag in ("article", "main"):
        return any({"comment", "comments", "reply", "ad", "advert", "sponsored", "related"} & set(words) for words in node.names)
    named = {w for words in node.names for w in words}
    for words in node.names:
        found = _FURNITURE.intersection(words)
        if not found or not all(w in _FURNITURE or w in _COMMON or w in _OWN for w in words):
            continue
        if not found <= _DOUBTFUL:
            return True
        # doubtful words mean nothing in a name like article-header, nor on what holds an article's mark
        if doubtful and not named & _OWN and not node.marked:
            return True
    return False


def prune(nodes: list[Node], doubtful: bool = True) -> list[Node]:
    """Cut page furniture out of the tree, by doubtful names too unless told; what stays, in page order."""
    _counted(nodes)
    gone: set[int] = set()
    kept = []
    for node in nodes:
        if node.parent is not None and (id(node.parent) in gone or _is_furniture(node, doubtful)):
            gone.add(id(node))
        else:
            kept.append(node)
    for node in kept:
        if any(id(k) in gone for k in node.kids if not isinstance(k, str)):
            node.kids = [k for k in node.kids if isinstance(k, str) or id(k) not in gone]
    _counted(kept)
    return kept


def score(nodes: list[Node]) -> None:
    """Points of the paragraphs to their ancestors, fewer the farther, then each element's discount by link density."""
    for node in reversed(nodes):
        blocks = any(not isinstance(k, str) and k.tag in _BLOCK for k in node.kids)
        paragraph = node.tag in _PARAGRAPHS and not blocks or node.tag in ("div", "section", "article", "main") and node.own >= _MIN_POINTS_CHARS
        if paragraph and node.chars >= _MIN_POINTS_CHARS:
            points = 1 + node.commas + min(node.chars // 100, 3)
            up = node.parent if node.tag in _PARAGRAPHS else node
            for share in (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
                if up is None:
                    break
                up.score += points * share
                up = up.parent
        # points come from below, so they are complete here
        if node.score > 0:
            if node.tag == "article":
                node.score += 25
            elif node.tag == "main" or any(w in _ARTICLE for words in node.names for w in words):
                node.score += 10
            node.score *= 1 - node.linked / node.chars if node.chars else 0


def _lines(kept: list[Node | str]) -> list[str]:
    """The texts of the blocks of ``kept`` in page order."""
    out: list[str] = []
    line: list[str] = []
    todo: list[Node | str | None] = [*reversed(kept)]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            line.append(k)
            continue
        if k is None or k.tag in _BLOCK:
            if joined := _SPACES.sub(" ", "".join(line)).strip():
                out.append(joined)
            line.clear()
        if k is not None:
            if k.tag == "br":
                line.append(" ")
            if k.tag in _BLOCK:
                todo.append(None)
            todo += reversed(k.kids)
    if joined := _SPACES.sub(" ", "".join(line)).strip():
        out.append(joined)
    return out


#: Siblings that belong to the kept ones they stand between or beside, however short.
_MINOR = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header", "ul", "ol", "dl", "table", "p", "blockquote", "pre", "figure", "div", "section"}


def _minor(sibling: Node) -> bool:
    return sibling.tag in _MINOR and sibling.chars > 0 and sibling.linked < 0.25 * sibling.chars


def _with_minor(kids: list, kept: list[bool]) -> list[bool]:
    """Adds to the kept ones of ``kids`` the minor elements next to them, one after another, and what else is no block between two of them."""
    kept = list(kept)
    for order in (range(len(kids)), range(len(kids) - 1, -1, -1)):
        beside = False
        for i in order:
            if isinstance(kids[i], str) and not kids[i].strip() or not isinstance(kids[i], str) and kids[i].tag in ("br", "hr", "img"):
                continue
            kept[i] = kept[i] or beside and not isinstance(kids[i], str) and _minor(kids[i])
            beside = kept[i]
    found = [i for i, k in enumerate(kept) if k]
    for i in range(found[0], found[-1]) if found else ():
        k = kids[i]
        kept[i] = kept[i] or isinstance(k, str) or _minor(k) or k.tag not in _BLOCK
    return kept


def _keeps(sibling: Node, best: Node) -> bool:
    if sibling.score >= max(10.0, 0.2 * best.score) and sibling.tag not in ("ul", "ol", "dl", "table"):
        return True
    return sibling.tag in ("p", "blockquote", "pre", "section", "div", "figure") and sibling.chars > 80 and sibling.linked < 0.25 * sibling.chars


def extract(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    nodes = prune(parse(page))
    score(nodes)
    if not nodes[0].marked and not any(n.score > 0 for n in nodes):  # no paragraph is outside what bears a doubtful name
        nodes = prune(parse(page), doubtful=False)
        score(nodes)
    best = max(nodes, key=lambda n: n.score)  # the first, so the outermost, of equals
    if best.score <= 0:
        best = next((n for n in nodes if n.tag in ("article", "main")), nodes[0])
    strongest = best
    up: Node | None = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = best if up is None else up
    kept: list[Node | str] = [best]
    if best.parent is not None:
        kids = best.parent.kids
        chosen = _with_minor(kids, [not isinstance(k, str) and (k is best or _keeps(k, strongest)) for k in kids])
        kept = [k for k, stays in zip(kids, chosen, strict=True) if stays]
    return "\n".join(_lines(kept))


def main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) with text and n_chars."""
    bound_batches(pages.sparkSession)
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    passed = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [extract(h.as_py()) for h in part.column(passed)]
                yield pa.RecordBatch.from_arrays([*part.columns[:passed], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html).alias("_" + "_".join(keep))).mapInArrow(run, schema)
