"""Main-text extraction from web pages by scores on the element tree.

Each page is worked on by itself inside Arrow batches: no shuffle, memory follows the batch. The page becomes a light tree;
scripts, styles, forms, menus and other furniture are left out by element name or by the words of class and id. Every
paragraph passes points (one, its commas, its length) to its ancestors, halved and then divided by their distance, and
discounted by the share of its characters that are link text. The container with the most points, discounted in the same way,
is taken; inside an article or main, or where only headings and prose stand beside it, the outer element is. It is kept whole, lists
of links included, with those siblings that score near it or are prose themselves and the headings before them. A page without
any prose is its own container; lists of links are left out only there. Words of class and id never remove what holds most of a page's
points (inside an article or main: four fifths of them), unless an article or main stands beside it, nor, where they may mean content
too, long prose inside an article that has no words of notices, letters or replies. Of articles only those are left out that a whole word
of their class marks as a comment or a teaser, if there is other text. A header inside an article or main stays if it holds a heading.
Loose text beside the container is taken as a paragraph. The tree is built in time in proportion to the page.

Defined results: null and empty pages give the empty text; unclosed, crossed and cut-off markup is read as far as it goes;
pages may repeat and ids may be null; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import map_texts, text_of

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)|[^<]+|<""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_FURNITURE = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|side-?bar\w*|aside|widget\w*|cookies?\w*|consent|gdpr|notices?|alert\w*|dialog|popup|modal|newsletter|subscri\w*|signup|comments?|comment-?list|disqus|repl(?:y|ies)|respond|share\w*|sharing|social\w*|related|recommend\w*|teasers?|latest|trending|popular|pagination|pager|toolbar|legal|copyright|complementary|navigation|contentinfo|search)(?:$|[-_\s])", re.I)
#: Of these words, those that articles use for prose of their own as well (a share price, legal news, a header of a section).
_WEAK = re.compile(r"(?:^|[-_\s])(?:header|masthead|foot|legal|share\w*|sharing|search|toolbar|widget\w*|latest|trending|popular)(?:$|[-_\s])", re.I)
#: Words of notices, letters, adverts and reader comments: such a block is no prose of the article, whatever its length.
_NOTICE = re.compile(r"\b(?:cookies?|gdpr|consent|newsletters?|subscri\w+|unsubscribe|sign(?:ed)? (?:up|in)|log(?:ged)? in|advertis\w+|sponsored|reply|replies|leave a comment|all rights reserved|privacy policy|terms of (?:use|service))\b", re.I)
#: Whole class words that make an article a reader's comment or a teaser; other words say nothing of an article.
_CARD = re.compile(r"(?:^|\s)(?:(?:reader-|user-)?comments?(?:-(?:item|body|box|card|content|entry|thread|wrapper|list))?|repl(?:y|ies)|respond|teasers?|(?:related|recommended|promo|sponsored|advert|ad)(?:-(?:article|card|item|post|story|teaser))?)(?:$|\s)", re.I)
_LISTS = {"ul", "ol", "dl", "table"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noframes"}
_DROPPED = {"nav", "header", "footer", "aside", "form", "svg", "button", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video", "map", "fieldset", "annotation", "annotation-xml"}
#: Of these, those that stand inside a line of text: what is around them stays one block.
_INLINE = {"svg", "button", "select", "object", "canvas", "audio", "video", "map", "annotation", "annotation-xml"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {"p", "div", "article", "section", "main", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "hr", "address", "center", "details", "summary", "hgroup"} | _DROPPED
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"} - _INLINE
#: A start tag ends an open element of the set; the search stops at the scope's elements.
_IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?](?:\s|$)|[。！？]")


class Node:
    __slots__ = ("tag", "parts", "parent", "block", "dropped", "weak", "points", "chars", "links", "card", "notice", "scored", "held", "first", "last", "bodies")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped, self.weak, self.card, self.notice = tag, parent, dropped, False, False, False
        self.block = None if parent is None else parent if parent.tag in _BLOCK else parent.block  # the block around it
        self.parts: list = []
        self.points, self.scored, self.chars, self.links, self.held = 0.0, False, 0, 0, 0.0
        self.first = self.last = self.bodies = 0


def _named(attributes: str) -> str:
    return " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes else ""


class _Open:
    """The open elements, with the depths at which each tag is open, so that no search climbs the stack."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {}, []

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def depth(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, depth: int) -> None:
        """Close the element at a depth and all in it; each is closed once, whatever the page."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in _BLOCK:
                self.blocks.pop()


def parse(page: str) -> tuple[Node, list[Node]]:
    """The page as a tree of nodes and texts, where what is left out is marked as dropped, and the nodes that only their class or id drops."""
    root = Node("html", None, False)
    open_ = _Open(root)
    named: list[Node] = []
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                open_.top.parts.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            depth = open_.depth((tag,))
            if depth and (tag in _BLOCK or not open_.blocks or open_.blocks[-1] < depth):
                open_.pop_to(depth)
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            open_.top.parts.append(" ")
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            if tag != "wbr":
                open_.top.parts.append(" " if tag not in _BLOCK else Node(tag, open_.top, True))
            continue
        if tag in ("html", "body"):
            open_.pop_to(open_.depth(("head",)) or len(open_.stack))
            continue
        closing, scope = _IMPLIED.get(tag, (("p",), ("td", "th", "button", "table")) if tag in _CLOSES_P else ((), ()))
        if (depth := open_.depth(closing)) > open_.depth(scope):
            open_.pop_to(depth)
        words = "" if tag == "main" or tag in _DROPPED else _named(m[3])
        node = Node(tag, open_.top, tag in _DROPPED or bool((_CARD if tag == "article" else _FURNITURE).search(words)))
        if node.dropped and tag not in _DROPPED:
            node.card = tag == "article"
            node.weak = not node.card and not _FURNITURE.search(_WEAK.sub("  ", words))
            named.append(node)
        if tag in _HEADINGS and (depth := open_.depth(("header",))) > open_.depth(("article", "main")) > 0:
            open_.stack[depth].dropped = False
        open_.top.parts.append(node)
        open_.push(node)
    return root, named


def _measure(node: Node, in_link: bool, below: list[Node]) -> None:
    """Characters and link characters of each node, without what is dropped; iterative, as trees can be deep."""
    stack = [(node, in_link, False)]
    while stack:
        n, link, done = stack.pop()
        if done:
            n.last = len(below)
            if n.parent and not n.dropped:
                n.parent.chars += n.chars
                n.parent.links += n.links
            continue
        n.first = len(below)
        n.bodies = (n.parent.bodies if n.parent else 0) + (n.tag in ("article", "main") and not n.card)
        below.append(n)
        stack.append((n, link, True))
        link = link or n.tag == "a"
        for p in n.parts:
            if isinstance(p, str):
                c = len(p) if not p.isspace() else 0
                n.chars += c
                n.links += c * link
            elif not p.dropped:
                stack.append((p, link, False))


def _own_text(n: Node) -> str:
    """Text of a node down to, and without, the blocks in it."""
    out, stack = [], list(reversed(n.parts))
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            out.append(p)
        elif not p.dropped and p.tag not in _BLOCK:
            stack.extend(reversed(p.parts))
    return "".join(out)


def _density(n: Node) -> float:
    return n.links / n.chars if n.chars else 0.0


def _points(n: Node) -> float:
    if n.tag not in _BLOCK or not n.chars:
        return 0.0
    text = _own_text(n).strip()
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - _density(n)) if len(text) >= 25 else 0.0


def _restore(root: Node, named: list[Node]) -> None:
    """Take back the dropping by class: of nodes with over half of the page's points (four fifths inside an article or main), unless
    an article or main stands apart from them; inside an article or main, of long prose with few links whose class words are no
    sure sign of furniture; and of articles marked as comments or teasers, if these are all that the page has."""
    for n in named:
        n.dropped = False
    nodes: list[Node] = []
    _measure(root, False, nodes)
    for n in reversed(nodes):
        n.held += _points(n)
        n.notice = n.notice or any(isinstance(p, str) and _NOTICE.search(p) for p in n.parts)
        if n.parent:
            n.parent.held += n.held
            n.parent.notice = n.parent.notice or n.notice
    marked = [n for n in named if n.card]
    other = root.held - sum(n.held for n in marked if not any(m.first < n.first < m.last for m in marked)) if marked else 0.0
    bodies = [n.first for n in nodes if n.tag in ("article", "main") and n.held and not n.card]
    for n in named:
        if n.card:
            n.dropped = other > 0
            continue
        inside = bisect_left(bodies, n.last) - bisect_left(bodies, n.first)
        apart = len(bodies) > n.bodies + inside
        n.dropped = not (n.held > root.held * (0.8 if n.bodies else 0.5) and not apart or n.weak and n.bodies and n.chars >= 200 and _density(n) < 0.1 and not n.notice)
    for n in nodes:
        n.chars = n.links = 0


def _score(nodes: list[Node]) -> None:
    for n in nodes:
        points = _points(n)
        if not points:
            continue
        level, up = 0, n if n.tag in ("div", "section", "article", "main", "td", "html") else n.block
        while up is not None and level < 5:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up.scored = True
            level, up = level + 1, up.block


def _blocks(n: Node, out: list[str], links: bool = True) -> None:
    """Texts of the blocks below n in page order; without ``links``, lists and tables made of links are left out."""
    text: list[str] = []

    def flush() -> None:
        if t := _SPACE.sub(" ", html.unescape("".join(text))).strip():
            out.append(t)
        text.clear()

    stack: list = list(reversed(n.parts))
    while stack:
        p = stack.pop()
        if p is None:
            flush()
        elif isinstance(p, str):
            text.append(p)
        elif p.dropped:
            if p.tag in _BLOCK and p.tag not in _INLINE:
                flush()
        elif p.tag in _BLOCK:
            flush()
            if links or not (p.tag in ("ul", "ol", "dl", "table", "div", "section") and _density(p) > 0.5):
                stack.append(None)
                stack.extend(reversed(p.parts))
        else:
            stack.extend(reversed(p.parts))
    flush()


def _heading(n: Node) -> bool:
    """A heading, or an element that holds nothing else."""
    while n.tag not in _HEADINGS:
        inner = [p for p in n.parts if isinstance(p, Node) and not p.dropped and p.chars]
        if len(inner) != 1 or inner[0].tag not in _BLOCK or any(isinstance(p, str) and not p.isspace() for p in n.parts):
            return False
        n = inner[0]
    return True


def _prose(n: Node) -> bool:
    if n.tag == "p":
        text = _own_text(n).strip()
        return len(text) > 80 and _density(n) < 0.25 or 0 < len(text) <= 80 and not n.links and bool(_SENTENCE.search(text))
    out: list[str] = []
    _blocks(n, out)
    text = " ".join(out)
    if n.tag in ("blockquote", "pre", "figure") and not n.links or n.tag in _LISTS and _density(n) < 0.25:
        return bool(text)
    return len(text) > 80 and _density(n) < 0.25 and bool(_SENTENCE.search(text))


def _beside(n: Node) -> list[Node]:
    return [s for s in n.parent.parts if isinstance(s, Node) and s is not n and not s.dropped and s.tag in _BLOCK and s.chars]


def _outer(best: Node) -> Node:
    """The article or main around a node; else its parent as long as only headings and prose stand beside it there."""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        return up
    while best.parent and best.parent.parent and (beside := _beside(best)) and all(_heading(s) or _prose(s) for s in beside):
        best = best.parent
    return best


def extract(page: str) -> str:
    """The page's main text: its blocks in page order, joined by one line feed."""
    root, named = parse(page)
    if named:
        _restore(root, named)
    nodes: list[Node] = []
    _measure(root, False, nodes)
    _score(nodes)
    final = {id(n): n.points * (1 - _density(n)) for n in nodes if n.scored and n.tag in _BLOCK}
    body = next((n for n in nodes if n.tag in ("article", "main") and n.chars), root)
    best = max((n for n in nodes if id(n) in final), key=lambda n: final[id(n)], default=body)
    if body is root and not any(n.tag in _BLOCK and n.chars > 80 and len(_own_text(n).strip()) > 80 for n in nodes):
        best = root
    least = 0.2 * final.get(id(best), 0.0)
    while best.parent and best.tag in ("p", "li", "tr", "td", "tbody", "h1", "h2", "h3", "blockquote", "pre"):
        best = best.parent
    best = _outer(best)
    out: list[str] = []
    if best.parent is None:
        _blocks(best, out, links=False)
        return "\n".join(out)
    waiting: list[Node] = []
    for s in _runs(best.parent, best):
        if s is not best and _heading(s):
            waiting.append(s)
        elif s is best or _prose(s) or 0 < least <= final.get(id(s), 0.0) and _density(s) < 0.3:
            for n in [*waiting, s]:
                _blocks(n, out)
            waiting = []
        else:
            waiting = [n for n in waiting if n.tag == "h1"]
    return "\n".join(out)


def _runs(parent: Node, best: Node) -> list[Node]:
    """The blocks of a node, with each run of loose text between them as a paragraph."""
    out: list[Node] = []
    loose: Node | None = None
    for p in parent.parts:
        if isinstance(p, Node) and (p is best or p.tag in _BLOCK):
            loose = None
            if p is best or not p.dropped and p.chars:
                out.append(p)
        elif isinstance(p, str) or not p.dropped:
            if loose is None:
                out.append(loose := Node("p", parent, False))
            loose.parts.append(p)
            loose.chars += p.chars if isinstance(p, Node) else len(p) if not p.isspace() else 0
            loose.links += p.links if isinstance(p, Node) else 0
    return [p for p in out if p.chars or p is best]


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    read = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return map_texts(read, run, "page_id long, url string, text string, n_chars long", "html")
