"""Main text of web pages by composite text density (operator 9).

A forgiving reader makes the tree of a page. Every node gets its characters per tag,
adjusted for the characters and tags of links; a node's density sum adds its children's
densities. Under the body, the node of the largest density sum is the article's core; the
smallest density on the path from the body to it is the threshold under which parts are
noise, and whatever else reaches it, with what stands between, is the article too. Elements that are never article text are taken out first, as are those whose class, id
or role names noise, unless they hold the page's articles or most of its text.

A header inside an article or main element heads the article and stays; others are the page's and go, as do asides.
Inside a part that is kept, lists and other containers that are mostly links go; paragraphs, headings and quotes
stay, however much of them is a link.

Defined cases: null, empty and text-less pages give an empty text; repeated rows each give
a row; an empty table gives an empty result; other columns are ignored; the whole page is
read, however long; unclosed and crossing tags are repaired.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_TAG_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
#: Elements whose content isn't markup or never shown.
RAW = frozenset("script style noscript template textarea title iframe svg".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside button select option menu dialog head object embed audio video canvas annotation annotation-xml".split())
#: Elements that count as named noise, as they may wrap a page.
FORMS = frozenset("form fieldset label".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded".split()
)
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id and role that mark what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer header masthead comment comments disqus reply replies respond cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget form search complementary contentinfo alert toolbar pagination pager".split()
)
#: Words that beside a word of noise say where or what it is.
PLACES = frozenset(
    "site page main top bottom left right global primary secondary tertiary container wrapper wrap box block bar list lists links buttons button icons icon area "
    "inner outer column col section panel region module item items articles posts stories news media tools controls form field input user email mobile desktop sticky fixed".split()
)
KEEPS = frozenset("body html article main".split())
#: Words of names for readers' comments, and those that make a name speak of the layout (has-sidebar).
TALK = frozenset("comment comments disqus reply replies respond".split())
LAYOUT = frozenset("has with no without".split())
#: Characters outside comments that can be an article.
LEFT = 200
#: Elements that end an open one of their name, up to the innermost of the second line.
ITEMS = frozenset("li dd dt tr td th option".split())
LISTS = frozenset("ul ol dl table tbody thead select menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text.
RUNNING = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
#: Elements of running text that links don't make a menu, so that a part that is kept keeps them.
PROSE = HEADINGS | frozenset("p blockquote pre figcaption caption dt dd td th".split())
#: Beside the article's own path, a part as plain as this share of the path's least is the article's too.
SLACK = 0.5
#: Characters outside links per tag that are running text wherever they stand.
PLAIN = 100


class Node:
    __slots__ = ("block", "chars", "children", "density", "depth", "link_chars", "link_tags", "mark", "name", "noise", "own", "parent", "rows", "tags")

    def __init__(self, name: str, parent: Node | None, noise: bool = False, mark: str = ""):
        self.name, self.parent, self.noise, self.mark, self.children = name, parent, noise, mark, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.own = 0.0


def _is_noise(name: str, attrs: str) -> tuple[bool, str]:
    """Whether an element is never shown or never text, and else how its names mark it: "" (not), "part", "own" (a whole name is noise) or "talk" (readers' comments)."""
    if name in NEVER:
        return True, ""
    mark = "own" if name in FORMS else ""
    if name in KEEPS or not attrs or attrs.isspace():
        return False, mark
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, ""
        if key in ("class", "id", "role"):
            for token in value.split():
                words = {w.lower() for w in _WORDS.split(token) if w}
                if NOISE.isdisjoint(words) or not LAYOUT.isdisjoint(words):
                    continue
                if not TALK.isdisjoint(words):
                    mark = "talk"
                elif mark != "talk":
                    mark = "own" if words <= NOISE | PLACES else mark or "part"
    return False, mark


def _drop_named(root: Node) -> None:
    """Takes out the elements whose names mark them, unless they hold the page's articles or most of its text.

    Comments go wherever text for an article is left without them. A name that only has a word of noise in it
    needs the text's agreement: mostly links, or less plain than half the page outside its articles."""
    order, stack = [], [(root, False, False)]
    inside: dict[Node, bool] = {}
    link: dict[Node, bool] = {}
    while stack:
        n, within, linked = stack.pop()
        order.append(n)
        within, linked = within or n.name in ("article", "main"), linked or n.name == "a"
        inside[n], link[n] = within, linked
        stack.extend((c, within, linked) for c in n.children if isinstance(c, Node) and not c.noise)
    if not any(n.mark for n in order):
        return
    chars: dict[Node, int] = {}
    links: dict[Node, int] = {}
    tags: dict[Node, int] = {}
    held: dict[Node, int] = {}
    titles: dict[Node, int] = {}
    for n in reversed(order):
        kids = [c for c in n.children if isinstance(c, Node) and not c.noise]
        own = sum(len(c) - sum(map(c.count, " \n\t\r")) for c in n.children if isinstance(c, str))
        chars[n] = own + sum(chars[c] for c in kids)
        links[n] = own * link[n] + sum(links[c] for c in kids)
        tags[n] = 1 + sum(tags[c] for c in kids)
        held[n] = (n.name in ("article", "main")) + sum(held[c] for c in kids)
        titles[n] = (n.name == "h1") + sum(titles[c] for c in kids)
    plain = lambda n: (chars[n] - links[n]) / tags[n]
    for n in order:
        if n.mark and not (held[n] and held[n] == held[root]):
            rest, share = chars[root] - chars[n], chars[n] / max(1, chars[root])
            if n.mark == "part":
                agrees = links[n] > 0.3 * chars[n] or not inside[n] and not titles[n] and plain(n) < 0.5 * plain(root)
                n.noise = not chars[n] or share <= 0.5 and agrees
            else:
                n.noise = not chars[n] or share <= 0.75 or n.mark == "talk" and rest >= LEFT


class _Scanner:
    """Tags of a page and the text between them, in one pass.

    A tag ends at the first > outside quoted values; a value whose quote doesn't close before other markup begins
    is no value, and its tag ends at the first > after it. A tag that never ends takes what is left, as in browsers."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}

    def _find(self, what: str, at: int) -> int:
        return self.page.find(what, at) if self.last[what] >= at else -1

    def _end(self, at: int) -> int:
        """Where the > of the tag is whose name ends at ``at``; -1: nowhere."""
        page = self.page
        if self.last[">"] < at:
            return -1
        while m := _TAG_STOP.search(page, at):
            at = m.start()
            if m[0] == ">":
                return at
            if not page[max(0, at - 16) : at].rstrip().endswith("="):
                at += 1  # a stray quote
                continue
            close = self._find(m[0], at + 1)
            if close < 0:
                return self._find(">", at)
            after = page[close + 1 : close + 2]
            stray = after not in ("", ">", "/") and not after.isspace()
            if stray and "<" in (value := page[at:close]) and ">" in value:
                return self._find(">", at)
            at = close + 1
        return -1

    def __iter__(self):
        """(text before, name, closing, attributes); the name is empty where only text is left."""
        page, at, text = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), at):
                mark, skip = ("-->", 3) if page.startswith("<!--", at) else ("]]>", 3) if page.startswith("<![CDATA[", at) else (">", 1)
                yield page[text:at], "", False, ""
                end = page.find(mark, at + 2)
                at = text = len(page) if end < 0 else end + skip
                continue
            m = _NAME.match(page, at + 1)
            if not m:
                at += 1
                continue
            name, end = m[2].lower(), self._end(m.end())
            attrs = page[m.end() : end] if end >= 0 else ""
            yield page[text:at], (name if end >= 0 and not (name in RAW and not m[1]) else ""), bool(m[1]), attrs
            at = text = len(page) if end < 0 else end + 1
            if name in RAW and not m[1] and end >= 0 and not (name == "svg" and attrs.endswith("/")):
                close = _RAW_END[name].search(page, at)
                end = self._find(">", close.end()) if close else -1
                at = text = len(page) if end < 0 else end + 1
        yield page[text:], "", False, ""


def tree(page: str) -> Node:
    """The page's nodes; children are nodes and strings of text. Each step looks at the innermost open elements by name, never along the path."""
    root = Node("html", None)
    root.depth, root.block, root.rows = 0, root, root
    here = root
    opened: dict[str, list[Node]] = {"html": [root]}

    def back_to(n: Node) -> None:
        nonlocal here
        while here is not n:
            opened[here.name].pop()
            here = here.parent

    for before, name, closing, attrs in _Scanner(page):
        if before:
            here.children.append(_html.unescape(before) if "&" in before else before)
        if not name or name == "html" and not closing:
            continue  # comments, declarations, and what is never shown
        if closing:
            n = opened.get(name, [])[-1:]
            # an inline element closed from inside a block that it doesn't enclose in the source's sense stays open
            if n and n[0] is not root and not (name in INLINE and here.block.depth > n[0].depth):
                back_to(n[0].parent)
            continue
        if name == "body" and here.name == "head":
            back_to(here.parent)
        if name in ENDS_P and here.block.name == "p":
            back_to(here.block.parent)
        if name in ITEMS:
            n = opened.get(name, [])[-1:]
            if n and n[0].depth > here.rows.depth:
                back_to(n[0].parent)
        noise, mark = _is_noise(name, attrs)
        node = Node(name, here, noise or name == "header" and not (opened.get("article") or opened.get("main")), mark)
        here.children.append(node)
        if name not in VOID and not attrs.endswith("/"):
            node.depth = here.depth + 1
            node.block = here.block if name in INLINE else node
            node.rows = node if name in LISTS else here.rows
            opened.setdefault(name, []).append(node)
            here = node
    _drop_named(root)
    return root


def _measured(root: Node) -> list[Node]:
    """All nodes outside noise, parents first, with characters and tags of their subtrees summed."""
    order, stack = [], [(root, False)]
    links = {}
    while stack:
        n, link = stack.pop()
        link = link or n.name == "a"
        links[n] = link
        order.append(n)
        for c in n.children:
            if isinstance(c, Node):
                if not c.noise:
                    stack.append((c, link))
            else:
                k = len(c) - sum(map(c.count, " \n\t\r"))
                n.chars += k
                n.link_chars += k * link
    for n in reversed(order):
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + (n.name not in INLINE or n.name == "a")
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags + (n.name == "a")
    body = next((n for n in order if n.name == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in order:
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        n.own = sum(_density(len(c) - sum(map(c.count, " \n\t\r")), 0, 0, 0, share) for c in n.children if isinstance(c, str) and n.name != "a")
    return order


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite density: characters per tag, scaled down by the share of links inside and in the whole body."""
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / t * max(0.0, math.log(chars / lc * t / lt)) / base


def article(root: Node) -> tuple[Node, float]:
    """The node of the largest density sum (of its children and own text; the outermost of equals) and the threshold from its path to the body."""
    best, most = root, -1.0
    for n in _measured(root):
        s = n.own + sum(c.density for c in n.children if isinstance(c, Node) and not c.noise)
        if n.chars and s > most * (1 + 1e-9):
            best, most = n, s
    threshold, n = best.density, best
    while n is not None and n.name not in ("html", "body"):
        threshold, n = min(threshold, n.density), n.parent
    return best, threshold


def _plainness(n: Node) -> float:
    """Characters outside links per tag: density without its growth by the part's size, so that a lone paragraph compares with a section."""
    return (n.chars - n.link_chars) / max(1, n.tags)


def _linked(n: Node) -> bool:
    return n.link_chars > 0.5 * n.chars


def parts(top: Node, threshold: float) -> list[Node]:
    """The nodes whose subtrees are the article, in page order: ``top`` and what else reaches the threshold.

    Beside the path from top to the body a part is kept if its density reaches the threshold, or its plainness
    reaches SLACK times the least on the path, or PLAIN where that is less. So are the blocks between two kept ones, a heading before the first, and
    running text that stands beside a kept part below the body. An article or main on the path is kept whole."""
    path = [top]
    while path[-1].parent is not None and path[-1].name != "body":
        path.append(path[-1].parent)
    whole = max((k for k, n in enumerate(path) if n.name in ("article", "main")), default=0)
    level = min(PLAIN, SLACK * min(map(_plainness, path)))
    kept = {path[whole]}

    def reaches(n: Node) -> bool:
        return bool(n.chars) and not _linked(n) and (n.density >= threshold or _plainness(n) >= level)

    for at, p in zip(path[whole:], path[whole + 1 :]):
        blocks = [c for c in p.children if isinstance(c, Node) and not c.noise and (c.chars or c is at)]
        good = []
        for k, c in enumerate(blocks):
            if c is at:
                good.append(k)
            elif reaches(c) or c.name in RUNNING and p.name not in ("html", "body") and not _linked(c):
                kept.add(c)
                good.append(k)
            else:
                stack = [x for x in c.children if isinstance(x, Node)]
                found = False
                while stack:
                    n = stack.pop()
                    if n.noise or n.name in INLINE:
                        continue
                    if reaches(n):
                        kept.add(n)
                        found = True
                    else:
                        stack.extend(x for x in n.children if isinstance(x, Node))
                if found:
                    good.append(k)
        kept.update(c for c in blocks[good[0] + 1 : good[-1]] if c is not at and c.chars and not _linked(c))
        for c in reversed(blocks[: good[0]]):
            if c.name not in HEADINGS:
                break
            kept.add(c)
    out, stack = [], [path[-1]]
    while stack:
        n = stack.pop()
        if n in kept:
            out.append(n)
        else:
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.noise)
    return out


def _blocks(top: Node, threshold: float) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        s = _SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if s:
            out.append(s)

    stack: list = [top]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            now.append(n)
        elif n is None:
            close()
        elif not n.noise and not (n is not top and n.name not in PROSE and n.name not in INLINE and n.chars and n.link_chars > 0.5 * n.chars and n.density < threshold):
            block = n.name not in INLINE
            if block:
                close()
                stack.append(None)
            stack.extend(reversed(n.children))
    close()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by spaces."""
    if not page:
        return ""
    root = tree(page)
    top, threshold = article(root)
    return " ".join(s for part in parts(top, threshold) for s in _blocks(part, threshold))


def _each(batches):
    for b in batches:
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    slim = pages.select("page_id", "url", "html")
    kinds = dict(slim.dtypes)
    return arrow_map(slim, _each, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
