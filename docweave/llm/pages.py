"""Leaf blocks of HTML pages: their text, where they stand, and features of both.

Skipped elements (`SKIPPED`) give no text, and nothing inside them opens or closes an element
outside; one that is never closed ends with the element around it. `math` is text within a line,
without its annotations. `object` and `noscript` are read like other elements: their blocks are
labelled like any. What a block takes grows with what its tags changed, not with how deep it stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Never text of a page.
SKIPPED = frozenset(
    "script style template iframe svg head title textarea select option annotation annotation-xml".split()
)
NOT_LEAVING_HEAD = SKIPPED | VOID | INLINE | {"noscript"}
#: What an opening tag closes if it is still open, up to the nearest of the containers.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}
CONTAINERS = frozenset(
    "ul ol dl table article section div main aside nav header footer form body html object noscript".split()
)
#: Elements of a page that no formula holds: they end one that was never closed.
NO_FORMULA = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure".split())
#: Elements that stand within a paragraph without ending it, though their blocks are their own.
WITHIN = frozenset(("object", "noscript"))
#: Marks the main text in labelled pages; no feature sees it.
LABEL = "data-main"

_TOKENS = re.compile(r"[a-z]+").findall
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Context:
    """Where a block stands: the open elements, as what each adds to the ones around it."""

    outer: Context | None
    added: tuple[str, ...]  # features that no element around it gives
    parent: str | None
    article: bool
    main: bool
    score: tuple[float, float] | None = None  # a place for what a model makes of the features

    def features(self) -> Iterator[str]:
        at: Context | None = self
        while at is not None:
            yield from at.added
            at = at.outer


@dataclass(slots=True)
class Block:
    text: str
    context: Context
    linked: float

    @property
    def main(self) -> bool:
        return self.context.main


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, Context]] = []
        self.places: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.given: set[str] = set()  # features of the open elements
        self.context = Context(None, (), None, False, False)
        self.parts: list[str] = []
        self.link_chars = 0
        # The skipped element that is being read, and the tags that are open inside it.
        self.skipped: str | None = None
        self.inner: Counter[str] = Counter()

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.context, min(1.0, self.link_chars / len(text))))
        self.parts, self.link_chars = [], 0

    def pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            tag, outer = self.stack.pop()
            self.places[tag].pop()
            if self.context is not outer:
                self.given.difference_update(self.context.added)
                self.context = outer

    def top(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close_open(self, tags: set[str], walls: frozenset[str]) -> None:
        """Closes the innermost element with one of the tags, unless a wall stands inside it."""
        at = max(map(self.top, tags))
        if at >= 0 and at >= max(map(self.top, walls), default=-1):
            self.pop(at)

    def push(self, tag: str, own: list[str], main: bool) -> None:
        outer = self.context
        features = [f"token:{token}" for token in own]
        if tag not in INLINE:
            features.append(f"in:{tag}")
        added = tuple(dict.fromkeys(f for f in features if f not in self.given))
        parent = outer.parent if tag in INLINE else tag
        if added or parent != outer.parent or main > outer.main:
            article = outer.article or tag in ("article", "main")
            self.context = Context(outer, added, parent, article, outer.main or main)
            self.given.update(added)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, outer))

    def end_skipped(self) -> None:
        self.skipped = None
        self.inner.clear()

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.skipped is not None:
            leaves_head = tag == "body" or not self.inner and tag not in NOT_LEAVING_HEAD
            if self.skipped != "head" or not leaves_head:
                if tag not in VOID and not tag == self.skipped == "option":
                    self.inner[tag] += 1
                return
            # A head that was never closed.
            self.end_skipped()
        if tag in SKIPPED:
            if tag in ("head", "title"):
                self.end_block()
            self.skipped = tag
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in NO_FORMULA and self.places.get("math"):
            self.pop(self.places["math"][0])
        if tag not in INLINE and not self.places.get("math"):
            self.end_block()
            if tag not in VOID and tag not in WITHIN:
                # A block that opens ends an open paragraph.
                self.close_open({"p"}, CONTAINERS)
        if tag in CLOSES:
            self.close_open(CLOSES[tag], CONTAINERS)
        if tag in VOID:
            return
        own, main = [], False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id", "role", "itemprop"):
                own += _TOKENS(_CAMEL.sub(" ", value).lower())
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                own.append("hidden")
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                own.append("hidden")
            elif name == LABEL:
                main = True
        self.push(tag, own, main)

    def handle_startendtag(self, tag: str, attrs) -> None:
        if self.skipped is not None:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in INLINE | SKIPPED or self.places.get("math")):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped is not None:
            if self.inner[tag]:
                self.inner[tag] -= 1
                if not self.inner[tag]:
                    del self.inner[tag]
                return
            if tag == self.skipped:
                self.end_skipped()
                return
            if self.top(tag) < 0:
                return
            # The element around a skipped one that was never closed.
            self.end_skipped()
        if tag not in INLINE and (not self.places.get("math") or 0 <= self.top(tag) < self.top("math")):
            self.end_block()
        self.close_open({tag}, frozenset() if tag in CONTAINERS else CONTAINERS)

    def handle_data(self, data: str) -> None:
        if self.skipped is None:
            self.parts.append(data)
            if self.places.get("a"):
                self.link_chars += len(data)


def leaf_blocks(html: str) -> list[Block]:
    """The text blocks of a page, in order. Any string gives a list; broken markup is read leniently."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.end_block()
    return reader.blocks


#: Words that say what a short block is.
KEYWORDS = frozenset(
    "cookie cookies consent privacy subscribe newsletter advertisement sponsored share tweet login "
    "register search menu home contact copyright rights reserved reply comment comments related read "
    "more sign next previous terms".split()
)
_SENTENCE_END = re.compile(r"[.!?…:;\"')\]]$").search


def block_features(blocks: list[Block], i: int) -> list[str]:
    """All features of a block: of its text, and of where it stands."""
    return [*text_features(blocks[i]), *blocks[i].context.features()]


def text_features(block: Block) -> list[str]:
    """The features that do not follow from the list of open elements."""
    words = block.text.split()
    size = min(len(words).bit_length(), 7)
    features = ["bias", f"words:{size}", f"linked:{round(block.linked * 3)}"]
    if block.context.parent:
        features.append(f"parent:{block.context.parent}")
    features.append("ended" if _SENTENCE_END(block.text) else "open")
    features.append(f"ended:{size}" if _SENTENCE_END(block.text) else f"open:{size}")
    if size <= 4:
        features += [f"says:{w}" for w in {word.strip(".,:!?").lower() for word in words} & KEYWORDS]
    if block.text[0] in "©®" or "©" in block.text:
        features.append("rights")
    if not block.context.article:
        features.append("no-article")
    return features
