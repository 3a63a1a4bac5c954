"""Main text of web pages by scoring the tree of each page.

Every paragraph earns points for its length and its commas; its parent gets them whole, further ancestors a share
that falls with the distance, and each candidate's sum is discounted by the share of its text that lies in links.
The best container is kept with those of its siblings that read like parts of the same article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements without content, of raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
    table tbody td tfoot th thead tr ul""".split())
#: Never part of an article: not shown as text, or furniture of the page.
NEVER = frozenset("""applet audio button canvas datalist embed footer form frame frameset head header iframe input link map meta nav
    noembed noframes noscript object script select style svg template textarea title video aside dialog menu search math""".split())
#: A header inside an article holds its title.
TITLES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Where a start tag ends an open paragraph, and what an open element of the same kind is ended by.
ENDS_PARAGRAPH = BLOCKS - frozenset(("body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "optgroup", "option", "legend", "summary"))
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"),
          "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
PARAGRAPHS = frozenset("p pre blockquote li dd td figcaption h1 h2 h3 h4 h5 h6".split())

#: Whole words of class, id, role and the like that mark page furniture.
FURNITURE = frozenset("""ad ads advert adverts advertisement advertising advertorial adsense adslot adbox adunit banner sponsor sponsored
    promo promotion promoted cookie cookies consent gdpr notice notices alert announcement popup modal overlay lightbox newsletter
    subscribe subscription signup paywall nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager paging
    sidebar sidebars aside rail widget widgets complementary footer footnav masthead topbar toolbar header contentinfo search
    comment comments commentlist respond replies reply disqus discussion share sharing social related recommended recommendations
    outbrain taboola skip skiplink tags tagcloud toc login signin""".split())
#: Elements that bear the article itself are furniture by their name only if that is about these.
ARTICLE_BEARERS = frozenset(("html", "body", "article", "main"))
#: A header named with one of these is that of the article.
OF_ARTICLE = frozenset("article post entry story".split())
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())
#: Elements whose content is not markup, with where it ends.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")

#: Points of a paragraph: one, one a comma, one for every so many characters up to a bound; share by distance.
CHARS_A_POINT, MOST_LENGTH_POINTS, SHORT = 100, 3, 25
BONUS = {"article": 25.0, "main": 10.0}
#: A sibling needs this share of the best score (and never less than this).
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0


class Node:
    """An element; ``parts`` are its texts and elements in page order."""

    __slots__ = ("tag", "parent", "parts", "out", "named", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, named: frozenset[str] = frozenset()):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        self.parts: list[str | Node] = []
        self.score, self.chars, self.linked = 0.0, 0, 0


def _names(attributes: str) -> tuple[frozenset[str], bool]:
    """Words of the naming attributes, and whether the element is hidden."""
    said, hidden = [], False
    for found in ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), unescape((found[2] or "").strip("\"'"))
        if name in ("class", "id", "role", "aria-label", "data-role", "itemprop"):
            said.append(CAMEL.sub(" ", value).lower())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value.lower())):
            hidden = True
    return frozenset(WORDS.findall(" ".join(said))), hidden


class _Tree:
    """Builds the tree; elements that cannot be part of an article are marked ``out`` with all they hold."""

    def __init__(self) -> None:
        self.root = self.here = Node("#page", None)
        self.open: dict[str, int] = {}

    def read(self, html: str) -> None:
        """One pass over the page; every search starts where the last one ended, so the time is that of its length."""
        at, whole = 0, True
        while (start := html.find("<", at)) >= 0:
            if start > at:
                self._text(html[at:start])
            if html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                if end < 0:
                    return
                at = end + 3
                continue
            sort = html[start + 1:start + 2]
            if sort == "/":
                sort = html[start + 2:start + 3] if html[start + 2:start + 3].isalpha() else "!"
            if not (sort.isalpha() and sort.isascii()) and sort not in ("!", "?"):
                self._text("<")
                at = start + 1
                continue
            found = TAG.match(html, start) if whole and sort not in ("!", "?") else None
            if found is None:  # a declaration, or a quotation mark that nothing closes
                whole = whole and sort in ("!", "?")
                end = html.find(">", start)
                if end < 0:
                    return
                found = LOOSE_TAG.match(html[start:end + 1])
                at = end + 1
            else:
                at = found.end()
            if found is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
                continue
            self._start(tag, found[3])
            if tag in RAW:
                end = RAW[tag].search(html, at)
                if end is None:
                    return
                at = end.start()
        self._text(html[at:])

    def _close(self, node: Node) -> None:
        while self.here is not node:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent
        self.open[node.tag] -= 1
        self.here = node.parent

    def _close_open(self, tags: tuple[str, ...], scopes: tuple[str, ...]) -> None:
        """Close the open elements of ``tags`` that lie within the innermost of ``scopes``."""
        while any(self.open.get(t) for t in tags):
            node = self.here
            while node.tag not in tags:
                if node.parent is None or node.tag in scopes:
                    return
                node = node.parent
            self._close(node)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_PARAGRAPH and self.open.get("p"):
            self._close_open(("p",), ("td", "th", "button", "object"))
        if tag in SAME_KIND:
            self._close_open(SAME_KIND[tag], SCOPES[tag])
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.here.parts.append(" " if tag == "br" else Node("hr", self.here, self.here.out))
            return
        named, hidden = _names(attributes) if attributes else (frozenset(), False)
        in_article = self.open.get("article", 0) or self.open.get("main", 0)
        never = tag in NEVER and not (tag == "header" and in_article)
        marks = COMMENTS if tag in ARTICLE_BEARERS or tag in TITLES else FURNITURE
        if named & OF_ARTICLE:
            named -= {"header"}
        out = self.here.out or never or hidden or (tag not in ("html", "body") and not named.isdisjoint(marks))
        node = Node(tag, self.here, out, named)
        self.here.parts.append(node)
        self.here = node
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.here.parts.append(" ")
        if tag in VOID or not self.open.get(tag):
            return
        node, inline = self.here, tag not in BLOCKS
        while node.tag != tag:
            if inline and node.tag in BLOCKS:
                return  # the end of an inline element closes no block
            node = node.parent
        self._close(node)

    def _text(self, text: str) -> None:
        if not self.here.out and text:
            self.here.parts.append(unescape(text) if "&" in text else text)


def _in_page_order(node: Node) -> Iterator[tuple[Node, bool]]:
    """(element, True) before and (element, False) after what it holds; furniture is passed by."""
    stack = [(node, True)]
    while stack:
        here, entering = stack.pop()
        yield here, entering
        if entering:
            stack.append((here, False))
            stack.extend((part, True) for part in reversed(here.parts) if isinstance(part, Node) and not part.out)


def _own_text(node: Node) -> str:
    """Text of a paragraph without the blocks inside it."""
    pieces, stack = [], [node]
    while stack:
        here = stack.pop()
        if isinstance(here, str):
            pieces.append(here)
        elif here is node or (here.tag not in BLOCKS and not here.out):
            stack.extend(reversed(here.parts))
    return " ".join("".join(pieces).split())


def _score(root: Node) -> None:
    """Points of every element, and how much of its text is text of links."""
    for node, entering in _in_page_order(root):
        if entering:
            node.score = BONUS.get(node.tag, 0.0) if node is not root else 0.0
    for node, entering in _in_page_order(root):
        if entering:
            continue
        node.chars += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
        loose = node.tag in BLOCKS and any(isinstance(p, str) and len(p.strip()) >= SHORT for p in node.parts)
        if node.tag in PARAGRAPHS or loose:
            text = _own_text(node)
            if len(text) < SHORT:
                continue
            points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / CHARS_A_POINT, MOST_LENGTH_POINTS)
            # loose text of a container counts for the container itself
            above, share = (node, 1.0) if loose and node.tag not in PARAGRAPHS else (node.parent, 1.0)
            distance = 0
            while above is not None and distance < 4:
                above.score += points * share
                distance += 1
                share = 1 / (2 * distance) if distance == 1 else 1 / (3 * distance)
                above = above.parent


def _worth(node: Node) -> float:
    return node.score * (1 - node.linked / node.chars) if node.chars else 0.0


def _kept(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    best = None
    for node, entering in _in_page_order(root):
        if entering and node.tag not in ("#page", "html", "a") and node.tag in BLOCKS and node.chars:
            if best is None or _worth(node) > _worth(best):
                best = node
    if best is None:
        return [root]
    # part of a list, table or quotation: what surrounds it is one article with it
    while best.parent.parent is not None and best.tag in PARAGRAPHS | {"ul", "ol", "dl", "table", "tbody", "tr", "thead", "tfoot"} and best.parent.tag != "body":
        best = best.parent
    for node in _ancestors(best):  # a named article holds all its sections
        if node.tag in ("article", "main"):
            best = node
            break
    if best.parent is None:
        return [best]
    least = max(SIBLING_LEAST, SIBLING_SHARE * _worth(best))
    siblings = [p for p in best.parent.parts if isinstance(p, Node) and not p.out]
    like = [p is best or (p.tag not in TITLES and _like_article(p, best, least)) for p in siblings]
    first, last = like.index(True), len(like) - 1 - like[::-1].index(True)
    # titles between kept parts stay, as do those right before the first
    while first and siblings[first - 1].tag in TITLES:
        first -= 1
    return [p for i, p in enumerate(siblings) if like[i] or (p.tag in TITLES and first <= i <= last)]


def _like_article(part: Node, best: Node, least: float) -> bool:
    if not part.chars:
        return False
    density = part.linked / part.chars
    if part.tag in PARAGRAPHS:
        text = _own_text(part)
        return (len(text) > 80 and density < 0.25) or (density == 0 and re.search(r"[.!?](\s|$)", text) is not None)
    alike = best.named and best.named == part.named and part.tag == best.tag
    return _worth(part) + (0.2 * _worth(best) if alike else 0.0) >= least


def _ancestors(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _blocks(kept: list[Node]) -> Iterator[str]:
    pieces: list[str] = []
    for top in kept:
        stack: list[Node | str | None] = [top]
        while stack:
            here = stack.pop()
            if isinstance(here, str):
                pieces.append(here)
                continue
            if here is None or here.tag in BLOCKS:  # None: the end of a block
                if pieces and (text := SPACE.sub(" ", "".join(pieces)).strip()):
                    yield text
                pieces = []
            if here is not None and not here.out:
                if here.tag in BLOCKS:
                    stack.append(None)
                stack.extend(reversed(here.parts))
    if pieces and (text := SPACE.sub(" ", "".join(pieces)).strip()):
        yield text


def main_text(html: str | None) -> str:
    """The article of one page: its blocks, white space inside them made single, joined by two line feeds."""
    if not html:
        return ""
    tree = _Tree()
    tree.read(html)
    _score(tree.root)
    return "\n\n".join(_blocks(_kept(tree.root)))


def extract_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with ``name``, the main text of each, and ``n_chars``, its code points; columns of these names are replaced.

    A null or empty page has the empty text, as has a page that is all furniture. Every row is worked out by itself,
    so repeated rows give equal texts and ties of two containers go to the first of the page. A page is held whole by
    one task: about ten times its size while its tree stands. Damaged markup is read on as browsers do: tags left
    open end with the page, stray end tags are ignored, unknown character references stay as they are.
    """
    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    return pages.withColumn(name, text_of(F.col(html))).withColumn("n_chars", F.char_length(name).cast("long"))
