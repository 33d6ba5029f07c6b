"""Leaf blocks of an HTML page, and the tag paths above them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

#: Fixed values of HTML: elements that end a block of text, that have no end tag, and whose contents are not text.
BLOCK = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math iframe object canvas audio video head title".split())
#: What the start of an element ends, if it is open within the nearest of the elements named.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_CLASS = re.compile(r"[^a-z0-9]+")


@dataclass
class Page:
    """Path tokens in the order in which elements open (sign 1) and end (sign -1), and the leaf blocks.

    A block is ``(events before it, number of tokens above it, text, share of linked text)``: its path is the sum of the
    events before it, so a page takes room and time in proportion to its length, however many elements stay open.
    """

    tokens: list[str]
    signs: list[int]
    blocks: list[tuple[int, int, str, float]]


class _Leaves(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, list[str]]] = []
        self.open: dict[str, list[int]] = {}  # where elements of a name stand in the path
        self.holding: list[int] = []  # where block elements but paragraphs stand in the path
        self.text: list[str] = []
        self.linked = self.silent = self.depth = 0
        self.page = Page([], [], [])

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.page.blocks.append((len(self.page.tokens), self.depth, text, min(1.0, self.linked / len(text))))
        self.text, self.linked = [], 0

    def _event(self, tokens: list[str], sign: int) -> None:
        self.page.tokens += tokens
        self.page.signs += [sign] * len(tokens)
        self.depth += sign * len(tokens)

    def _close(self, at: int) -> None:
        if max(self.holding[-1] if self.holding else -1, self._last("p")) >= at:
            self.flush()
        while len(self.path) > at:
            tag, tokens = self.path.pop()
            self.open[tag].pop()
            if self.holding and self.holding[-1] == len(self.path):
                self.holding.pop()
            self.silent -= tag in SILENT
            self._event(tokens, -1)

    def _last(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        tag = "".join(tag.split())
        if tag in BLOCK:
            self.flush()
            ends, within = ENDS.get(tag, ((), ()))
            at = self._last("p", *ends)
            if at > (self._last(*within) if ends else (self.holding[-1] if self.holding else -1)):
                self._close(at)
            if tag not in SILENT and self.path and self.path[-1][0] == "head":
                self._close(len(self.path) - 1)
        if tag in VOID:
            self.text.append(" ")
            return
        named = [x for key, value in attrs if key in ("class", "id", "role") and value for x in _CLASS.split(value.lower()) if x]
        self.open.setdefault(tag, []).append(len(self.path))
        if tag in BLOCK and tag != "p":
            self.holding.append(len(self.path))
        self.path.append((tag, tokens := [tag, *(f".{x}" for x in named)]))
        self._event(tokens, 1)
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a browser ignores the slash of what is not void

    def handle_endtag(self, tag: str) -> None:
        tag = "".join(tag.split())
        if (at := self._last(tag)) >= 0:
            self._close(at)
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if any(tag == "a" for tag, _ in self.path[-3:]):
                self.linked += len(data.strip())


def leaves(html: str | None) -> Page:
    """The leaf blocks of a page in order, with the events of path tokens: tags, and classes, ids and roles after a dot.

    White space within a block is one blank. Scripts, styles, the head and comments have no text. Elements left open end
    with what holds them. A null page has no blocks.
    """
    parser = _Leaves()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    parser._close(0)
    return parser.page
