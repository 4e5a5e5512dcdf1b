"""A page's element tree and text blocks, from HTML as it is found: unclosed, misnested, cut off."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math object audio video canvas noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
# an open element of the key's kind ends where one of these starts, up to the container
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Containers: the branches that a style tree judges.
CONTAINER = set("aside center details dialog div dl fieldset figure footer form header hgroup menu nav ol search section "
                "select table ul span".split())
#: Roots of the page's own content, whose text flow is never judged.
CONTENT = {"article", "main"}
_P_SCOPE = CONTAINER | CONTENT | {"p", "button"}

#: Where markup may start; a tag with quoted values; a tag whose quotes never close.  No pattern can run past the next
#: ``<`` outside quotes or try a character twice, so a page is read in linear time however broken it is.
_OPEN = re.compile(r"<[!?/a-zA-Z]")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)>")
_CUT = re.compile(r"<[/!?a-zA-Z]")
#: Elements deeper than this become siblings of the one above, as in browsers.
DEEPEST = 512
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little",
                          signed=True)


class Node:
    """An element: its tag, its step (tag, classes and id without digits), and a hash of the steps to it."""

    __slots__ = ("tag", "step", "path", "parent", "children", "blocks", "names", "depth")

    def __init__(self, tag: str, names: tuple[str, ...], step: str, parent: Node | None) -> None:
        self.tag, self.names, self.step, self.parent = tag, names, step, parent
        self.depth: int = parent.depth + 1 if parent else 0
        self.path: int = digest(f"{parent.path if parent else 0}/{step}")
        self.children: list[str] = []
        self.blocks: list[int] = []

    def above(self) -> Iterator[Node]:
        node: Node | None = self
        while node:
            yield node
            node = node.parent


def _names(attrs: str) -> tuple[str, ...]:
    found = []
    for m in _NAME.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        found += [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w]
    return tuple(found)


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, attributes) of comments, declarations (no tag) and tags in page order.

    From the first tag on whose quotes never close, quotes don't count.
    """
    at, size, quotes = 0, len(page), True
    while m := _OPEN.search(page, at):
        start = m.start()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        if page[start + 1] in "!?" or page[start + 1] == "/" and not page[start + 2:start + 3].isalpha():
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            yield start, at, "", "", ""
            continue
        tag = _TAG.match(page, start) if quotes else None
        if tag and not tag[4]:
            quotes = tag.end() == size or page[tag.end()] not in "\"'"
        if not (tag and tag[4]):
            tag = _PLAIN.match(page, start)
        if tag:
            at = tag.end()
            yield start, at, tag[1], tag[2].lower(), tag[3]
        else:
            at = start + 1


def parse(page: str) -> tuple[list[Node], list[tuple[str, Node]]]:
    """Elements in page order, and the text blocks with the innermost element that they stand in."""
    root = Node("#", (), "#", None)
    here, nodes, blocks, words = root, [], [], []
    block_at: Node = root
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                blocks.append((text, block_at))

    def leave(node: Node) -> Node:
        """Close all open elements up to ``node``; its parent is open then."""
        x = here
        while x is not node:
            open_tags[x.tag] -= 1
            x = x.parent
        open_tags[node.tag] -= 1
        return node.parent or root

    at, size = 0, len(page)
    for start, end, slash, tag, attrs in _tokens(page):
        if start < at:  # inside an element that is no text
            continue
        if start > at:
            if not words:
                block_at = here
            words.append(page[at:start])
        at = end
        if not tag:
            continue
        if slash:  # an end tag
            if tag in BLOCK:
                flush()
            elif tag == "br":
                words.append(" ")
            if open_tags[tag]:
                here = leave(next(n for n in here.above() if n.tag == tag))
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P and open_tags["p"]:
            p = next((n for n in here.above() if n.tag in _P_SCOPE), None)
            if p and p.tag == "p":
                here = leave(p)
        elif tag in ENDS:
            ends, stop = ENDS[tag]
            for n in here.above():
                if n.tag in stop:
                    break
                if n.tag in ends:
                    here = leave(n)
        if tag in VOID:
            words.append(" ")
            continue
        names = _names(attrs)
        step = ".".join((tag, *sorted(set(names))))
        if not here.children or here.children[-1] != step:
            here.children.append(step)
        if tag in RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = closing.end() if closing else size
            continue
        if here.depth >= DEEPEST:
            here = leave(here)
        here = Node(tag, names, step, here)
        open_tags[tag] += 1
        nodes.append(here)
    if at < size and here.tag not in RAW:
        cut = page[at:]  # a tag that the page's end cuts off is no text
        open_tag = _CUT.search(cut, cut.rfind(">") + 1)
        words.append(cut[:open_tag.start()] if open_tag else cut)
        block_at = block_at if len(words) > 1 else here
    flush()
    return nodes, blocks
