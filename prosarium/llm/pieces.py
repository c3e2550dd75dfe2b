"""Oversized texts and records to overlapping pieces that end at natural boundaries, by packing structure trees.

An item is parsed into a tree of nodes, each with a place where it begins and ends: a document into
sections, blocks, list items and elements of mark-up, sentences and words, a record into sentences,
elements and words. Sibling nodes are merged from the start of a piece as far as the limit allows; where
what is merged takes no more than half the limit, the next sibling is oversized: only there the tree is parsed one level
deeper, and its children are merged on.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WS, by_rows

#: Ends of a level's nodes within a node that lies in (begin, end), ascending.
Level = Callable[[int, int], list[int]]

PIECES = pa.schema([("item_id", pa.int64()), ("piece_no", pa.int32()), ("begin_pos", pa.int32()), ("end_pos", pa.int32())])
PIECES_DDL = "item_id long, piece_no int, begin_pos int, end_pos int"

_SENTENCE = re.compile(rf"[.!?…](?=[{WS}])|[。！？।؟]")
_SPACE = re.compile(rf"[{WS}]")
_WORD = re.compile(rf"[^{WS}]+")
#: Closing marks that may follow a sentence's mark within a word, and the marks (fixed values).
_CLOSING = "»”\")’'›"
_FINAL = (".", "!", "?", "…")


class Node:
    """A part [begin, end) of an item; its children are parsed when they are first asked for."""

    __slots__ = ("_children", "begin", "depth", "end", "levels")

    def __init__(self, begin: int, end: int, levels: list[Level], depth: int = 0):
        self.begin, self.end, self.levels, self.depth = begin, end, levels, depth
        self._children: list[Node] | None = None

    @property
    def children(self) -> list[Node]:
        """The nodes of the next level, one after the other without gaps; none below the last level."""
        if self._children is None:
            if self.depth == len(self.levels):
                self._children = []
            else:
                ends = [e for e in self.levels[self.depth](self.begin, self.end) if self.begin < e < self.end] + [self.end]
                self._children = [Node(b, e, self.levels, self.depth + 1) for b, e in zip([self.begin, *ends], ends)]
        return self._children


def merged_end(root: Node, start: int, limit: int) -> int:
    """End of the piece that begins at start: of the merged siblings on the highest level on which they take
    more than half the limit, or at the limit itself."""
    low, high = start + limit // 2, start + limit
    node = root
    while node.children:
        first = bisect_right(node.children, high, key=lambda n: n.end)  # the first sibling that doesn't fit
        if first and (end := node.children[first - 1].end) > low:
            return end
        node = node.children[first]
    return high


def pack(root: Node, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """[begin, end) of the pieces of an item; none if it fits the limit.

    A piece starts at 0 or `overlap` before the end of the last. What fits the limit is the last
    piece; any other ends more than limit / 2 and at most limit after its start.
    """
    if root.end <= limit:
        return
    if not 0 <= overlap <= limit // 2:
        raise ValueError("overlap must not exceed half the limit")
    start = 0
    while root.end - start > limit:
        end = merged_end(root, start, limit)
        yield start, end
        start = end - overlap
    yield start, root.end


def text_tree(text: str, structure: bool = False) -> Node:
    """Blocks (parted by blank lines), sentences and words of a text; with `structure` also its sections, which begin
    with headings, above the blocks, and list items and elements of mark-up below them."""

    def found(pattern: re.Pattern, more: int = 0) -> Level:
        return lambda begin, end: [m.end() for m in pattern.finditer(text, begin, min(len(text), end + more))]

    def blocks(begin: int, end: int) -> list[int]:
        # Every place after two line feeds, so that three of them give two places.
        return [m.start() + 2 for m in _BLANK.finditer(text, max(0, begin - 1), end)]

    sentences, words = found(_SENTENCE, 1), found(_SPACE)  # one more, which a mark's white space may be
    if not structure:
        return Node(0, len(text), [blocks, sentences, words])
    headings: Level = lambda begin, end: [m.start() for m in _HEADING.finditer(text, begin, end)]
    items: Level = lambda begin, end: sorted({m.start() if m["item"] else m.end() for m in _ITEM.finditer(text, begin, end)})
    return Node(0, len(text), [headings, blocks, items, sentences, words])


_BLANK = re.compile(r"(?=\n\n)")
#: Lines that open a section, as in Markdown or HTML, and what opens a list item or closes an element (fixed values).
_HEADING = re.compile(r"^[ \t]*(?:#{1,6}[ \t]|<h[1-6]\b)", re.MULTILINE | re.IGNORECASE)
_ITEM = re.compile(r"(?P<item>^[ \t]*(?:[-*+•–][ \t]|\(?\d{1,3}[.)][ \t]|<li\b))|</(?:p|s|li|ul|ol|div|section|prosody|h[1-6])\s*>|<break\b[^<>]*>", re.MULTILINE | re.IGNORECASE)


def element_tree(elements: list[str]) -> Node:
    """Sentences, elements and words of a record; places are words."""
    sentences, ends, n = [], [], 0
    for e in elements:
        words = _WORD.findall(e)
        sentences += [n + i + 1 for i, w in enumerate(words) if w.rstrip(_CLOSING).endswith(_FINAL)]
        n += len(words)
        if words:
            ends.append(n)

    def among(places: list[int]) -> Level:
        return lambda begin, end: places[bisect_right(places, begin) : bisect_left(places, end)]

    return Node(0, n, [among(sentences), among(ends)])


def split_texts(df: DataFrame, key: str, text: str, limit: int = 1500, overlap: int = 100, structure: bool = False) -> DataFrame:
    """PIECES_DDL of every text of more than `limit` characters; places are code points. With `structure` headings,
    lists and mark-up give borders, too (see text_tree).

    Null, empty and short texts have no pieces. A text without any border is cut at the limit.
    Each row is worked on by itself, whatever its length; repeated rows give repeated pieces.
    """

    def emit(k: int, t: str | None) -> Iterator[tuple]:
        if t is not None and len(t) > limit:
            for i, (b, e) in enumerate(pack(text_tree(t, structure), limit, overlap)):
                yield k, i, b, e

    # Short texts don't leave the JVM.
    return df.where(F.length(text) > limit).select(F.col(key).cast("long"), F.col(text)).mapInArrow(by_rows(emit, PIECES), PIECES_DDL)


def split_elements(df: DataFrame, key: str, elements: str, field: str, limit: int = 100, overlap: int = 10) -> DataFrame:
    """PIECES_DDL of every record whose elements' texts have more than `limit` words; places are words.

    Null lists, elements and texts are left out; blank texts have no words.
    """

    def emit(k: int, texts: list[str] | None) -> Iterator[tuple]:
        if texts:
            for i, (b, e) in enumerate(pack(element_tree(texts), limit, overlap)):
                yield k, i, b, e

    texts = F.filter(F.transform(F.col(elements), lambda e: e[field]), lambda t: t.isNotNull())
    # A text of n words has at least 2n - 1 characters, so many records are known to fit without being parsed.
    enough = F.aggregate(F.col("texts"), F.lit(0), lambda s, t: s + F.length(t) + 1) >= 2 * limit
    return df.select(F.col(key).cast("long"), texts.alias("texts")).where(F.coalesce(enough, F.lit(False))).mapInArrow(by_rows(emit, PIECES), PIECES_DDL)
