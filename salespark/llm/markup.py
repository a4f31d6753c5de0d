"""A forgiving reader for HTML: elements with their texts, in page order, and what is known about each element."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Element names of the HTML standard, by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes textarea select svg math object audio video canvas datalist".split())
IN_HEAD = frozenset("base link meta script style title noscript template head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td template tfoot th thead title tr ul script style".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre search section summary table ul li dt dd".split()
)
#: An opening element closes an open one of the first set, unless one of the second lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_CELLS = frozenset("td th caption table template html".split())

_TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>?|/(?P<end>[A-Za-z][^\s/>]*)[^>]*>?|/[^>]*>"
    r"|(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>?))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}


@dataclass
class Page:
    """Element 0 is the document. A piece is (element, text); a null text is the border of a block."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[dict[str, str]] = field(default_factory=lambda: [{}])
    pieces: list[tuple[int, str | None]] = field(default_factory=list)

    def add(self, tag: str, parent: int, attributes: dict[str, str]) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.attributes.append(attributes)
        return len(self.tags) - 1


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): unescape(value.strip("\"'")) for name, value in _ATTRIBUTE.findall(raw)} if "=" in raw or raw.strip(" />") else {}


def read_page(html: str | None) -> Page:
    """The page's elements and texts. Character references are decoded; unclosed and stray tags are settled as browsers do."""
    page, html, at = Page(), html or "", 0
    stack = [0]

    def text(raw: str) -> None:
        if raw:
            if page.tags[stack[-1]] == "head" and raw.strip():
                close(len(stack) - 1)
            page.pieces.append((stack[-1], unescape(raw)))

    def close(upto: int) -> None:
        while len(stack) > max(upto, 1):
            if page.tags[stack.pop()] in BLOCKS:
                page.pieces.append((stack[-1], None))

    def close_open(names: set[str] | frozenset[str], borders: set[str] | frozenset[str]) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            tag = page.tags[stack[i]]
            if tag in names:
                close(i)
                return True
            if tag in borders:
                break
        return False

    while (found := _TAG.search(html, at)) is not None:
        text(html[at : found.start()])
        at = found.end()
        if name := found["end"]:
            name = name.lower()
            if name in ("html", "body") or name in VOID:
                if name == "br":
                    page.pieces.append((stack[-1], " "))
                continue
            inline = name not in BLOCKS
            borders = (BLOCKS if inline else _CELLS) - {name}
            if name in HEADINGS:
                close_open(HEADINGS, borders - HEADINGS)
            else:
                close_open({name}, borders)
        elif name := found["start"]:
            name = name.lower()
            raw = found["attrs"].removesuffix(">")
            if page.tags[stack[-1]] == "head" and name not in IN_HEAD:
                close(len(stack) - 1)
            if name in ("html", "body") and name in (page.tags[i] for i in stack):
                continue
            if name in CLOSES:
                while close_open(*CLOSES[name]):
                    pass
            if name in ENDS_PARAGRAPH:
                close_open({"p"}, _CELLS | {"button"})
            if name in HEADINGS and page.tags[stack[-1]] in HEADINGS:
                close(len(stack) - 1)
            if name in BLOCKS:
                page.pieces.append((stack[-1], None))
            if name in VOID:
                if name in ("br", "hr"):
                    page.pieces.append((stack[-1], " "))
                continue
            stack.append(page.add(name, stack[-1], _attributes(raw)))
            if name in RAW:
                end = _ENDS[name].search(html, at)
                stop = end.start() if end else len(html)
                page.pieces.append((stack[-1], unescape(html[at:stop]) if name == "textarea" else html[at:stop]))
                at = stop
    text(html[at:])
    close(1)
    _split_mixed(page)
    return page


def _split_mixed(page: Page) -> None:
    """Text right inside an element that also has block children becomes a child of its own there."""
    mixed = {page.parents[i] for i in range(1, len(page.tags)) if page.tags[i] in BLOCKS and page.tags[page.parents[i]] not in UNSEEN}
    own, pieces = -1, []
    for node, text in page.pieces:
        if text is None:
            own = -1
        elif node in mixed and text.strip():
            if own < 0 or page.parents[own] != node:
                own = page.add("#text", node, {})
            node = own
        pieces.append((node, text))
    page.pieces = pieces


def kept_text(page: Page, kept: list[bool]) -> str:
    """The texts of kept elements: white space is one space, blocks are joined by one space."""
    return " ".join("".join(" " if text is None else text for node, text in page.pieces if text is None or kept[node]).split())
