"""Problem 6: cutting long texts at natural boundaries, by packing a structure tree.

A text is parsed into a tree: sections by the depth of their headings, blocks between blank lines, list items by their indentation, fenced blocks
as they are. Below these come lines, sentences, wrapped lines, words and characters. Sibling subtrees are merged bottom-up while they fit the room of a
piece; only a node that doesn't fit is descended into, so no cut parts a subtree that fits. What is left of a
node that was descended into isn't merged with the node's siblings; only a heading goes with the beginning of what follows it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.rows import each
from tapeloom.llm.sentences import Model, fitted, spans

LIMIT, OVERLAP = 2000, 200

Span = tuple[int, int]

_LINES = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_HEADING = re.compile(r"\s{0,3}(?:(#{1,6})(?:\s|$)|<h([1-6])\b)", re.IGNORECASE)
_UNDERLINE = re.compile(r"\s{0,3}(=|-)\1{2,}\s*$")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•]|\d{1,3}[.)])[ \t]+\S")
_FENCE = re.compile(r"\s{0,3}(```|~~~)")
_LINE_END = re.compile(r"\r\n|\n|\r")
_SPACE = re.compile(r"\s+")

#: What is below sections, blocks and items, coarse to fine: what may be cut there.
FINE = ("line", "sentence", "wrapped line", "word", "character")


@dataclass
class Node:
    """A subtree: the stretch of the text that it covers, white space after it included."""

    start: int
    end: int
    level: str
    children: list[Node] = field(default_factory=list)
    depth: int = 0
    heading: bool = False


def _blocks(text: str) -> list[Node]:
    """The blocks of a text in order: headings with their depth, fenced blocks, lists with their items below them, paragraphs."""
    found: list[Node] = []
    lines = [(m.start(), m.end(), m.group()) for m in _LINES.finditer(text) if m.end() > m.start()]
    fence, blank, alone = "", True, False  # alone: the last block is a paragraph of one line so far
    for start, end, line in lines:
        if fence:
            found[-1].end = end
            fence = "" if line.strip().startswith(fence) else fence
            blank = not fence
            continue
        if not line.strip():
            if found:
                found[-1].end = end
            blank, alone = True, False
            continue
        head, under, item, opened = _HEADING.match(line), _UNDERLINE.match(line), _ITEM.match(line), _FENCE.match(line)
        if head:
            found.append(Node(start, end, "block", depth=len(head[1] or "") or int(head[2]), heading=True))
            blank, alone = True, False
        elif under and alone:
            found[-1].end, found[-1].heading, found[-1].depth = end, True, 1 if under[1] == "=" else 2
            blank, alone = True, False
        elif opened:
            found.append(Node(start, end, "block"))
            fence, alone = opened[1], False
        elif item and found and found[-1].children and (not blank or item[1]):
            found[-1].children.append(Node(start, end, "item", depth=len(item[1].expandtabs(4))))
            found[-1].end, blank = end, False
        elif item and blank:
            found.append(Node(start, end, "block", [Node(start, end, "item", depth=len(item[1].expandtabs(4)))]))
            blank, alone = False, False
        elif blank and not (found and found[-1].children and line[0] in " \t"):
            found.append(Node(start, end, "block"))
            blank, alone = False, True
        else:
            found[-1].end, blank, alone = end, False, False
    for block in found:
        if block.children:
            block.children = _nested(block.children, block.end)
    return found


def _nested(items: list[Node], end: int) -> list[Node]:
    """List items in order to trees of them: an item holds what stands before the next item that isn't indented more."""
    top: list[Node] = []
    open_: list[Node] = []
    for item in items:
        while open_ and open_[-1].depth >= item.depth:
            open_.pop().end = item.start
        if open_:
            above = open_[-1]
            if not above.children:  # its own lines
                above.children.append(Node(above.start, item.start, FINE[0]))
            above.children.append(item)
        else:
            top.append(item)
        open_.append(item)
    for item in open_:
        item.end = end
    return top


def parsed(text: str) -> Node:
    """The tree of a text: the root's children are its blocks and sections; a section is its heading, its blocks and the sections of deeper headings."""
    root = Node(0, len(text), "text")
    open_ = [root]
    for block in _blocks(text):
        if block.heading:
            while len(open_) > 1 and open_[-1].depth >= block.depth:
                open_.pop().end = block.start
            section = Node(block.start, len(text), "section", [block], depth=block.depth)
            open_[-1].children.append(section)
            open_.append(section)
        else:
            open_[-1].children.append(block)
    first = root.children[0] if root.children else None
    while first:  # blank lines before the first block belong to it
        first.start, first = 0, first.children[0] if first.children else None
    return root


def _cut(a: int, b: int, at: list[int], level: str) -> list[Node]:
    """The parts of [a, b) between the given places."""
    places = [a, *(x for x in at if a < x < b), b]
    return [Node(x, y, level) for x, y in zip(places, places[1:])]


@dataclass
class _Text:
    """A text with the places where its sentences begin, and those of them that begin a line."""

    text: str
    sentences: list[int]
    lines: list[int]
    room: int
    whole: int

    def below(self, node: Node) -> list[Node]:
        """The children of a node; below sections, blocks and items by the next of FINE. White space belongs to the part before it."""
        if node.children:
            return node.children
        a, b = node.start, node.end
        level = FINE[FINE.index(node.level) + 1] if node.level in FINE else FINE[0]
        if level in FINE[:2]:
            places = self.lines if level == "line" else self.sentences
            return _cut(a, b, places[bisect_right(places, a) : bisect_left(places, b)], level)
        if level == "wrapped line":
            return _cut(a, b, [m.end() for m in _LINE_END.finditer(self.text, a, b)], level)
        if level == "word":
            return _cut(a, b, [m.end() for m in _SPACE.finditer(self.text, a, b)], level)
        return _cut(a, b, list(range(a + self.room, b, self.room)), level)

    def packed(self, node: Node) -> list[list]:
        """Parts [start, end, level of the cut at their start, whether whole siblings, whether a heading alone] of a node that doesn't fit the room.

        A sentence that fits ``whole`` is a part of its own.
        """
        parts: list[list] = []
        for child in self.below(node):
            fits = child.end - child.start <= self.room
            if fits or (child.level == "sentence" and child.end - child.start <= self.whole):
                below = [[child.start, child.end, child.level, fits, fits and child.heading]]
            else:
                below = self.packed(child)
            for n, (a, b, level, _, _) in enumerate(below):
                last = parts[-1] if parts else None
                if last and b - last[0] <= self.room and ((fits and last[3]) or (n == 0 and last[4])):
                    last[1], last[3], last[4] = b, fits, False
                else:
                    parts.append([a, b, child.level if n == 0 else level, fits, fits and child.heading])
        return parts


def cut(text: str, sentences: list[Span], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, offset where what is new begins, level of the cut before it) of each piece of ``text``.

    A piece holds at most ``limit`` characters, of which the first ``overlap`` repeat the end of the one before. A sentence that
    fits the limit but leaves no room for the whole overlap keeps whole and overlaps by what room is left.
    """
    if len(text) <= limit:
        return [(0, len(text), 0, "none")]
    lines = [b for (_, end), (b, _) in zip(sentences, sentences[1:]) if _LINE_END.search(text, end, b)]
    parts = _Text(text, [a for a, _ in sentences], lines, limit - overlap, limit).packed(parsed(text))
    found = []
    for i, (a, b, level, _, _) in enumerate(parts):
        begin = max(0, a - min(overlap, limit - (b - a))) if i else a
        found.append((begin, b, a, level if i else "none"))
    return found


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, model: Model | None = None) -> DataFrame:
    """(pos, n, start_at, end_at, new_at, cut_at): the pieces of every text of more than ``limit`` characters, in order.

    Texts that fit, NULL texts and rows with a NULL key have no pieces. Repeated rows count once; of several long texts under
    one key the one whose pieces sort last is taken. Other columns are not read.
    """
    return _exploded(_made(df, key, text, limit, overlap, model), "pieces")


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, model: Model | None = None) -> DataFrame:
    """(pos, start_at): the sentences that were cut inside because they alone exceed the limit."""
    made = _made(df, key, text, limit, overlap, model).where(F.size("broken") > 0)
    return made.select("pos", F.explode("broken").alias("start_at"))


def _made(df: DataFrame, key: str, text: str, limit: int, overlap: int, model: Model | None) -> DataFrame:
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be under the limit")
    model = model or fitted(df, key, text)
    rows = df.select(F.col(key).cast("long").alias("pos"), F.col(text).alias("text")).where((F.length("text") > limit) & F.col("pos").isNotNull())
    made = each(rows, "pos long, pieces array<struct<start_at:long,end_at:long,new_at:long,cut_at:string>>, broken array<long>", _row(limit, overlap, model), rows=512)
    return made.groupBy("pos").agg(F.max(F.struct("pieces", "broken")).alias("s")).select("pos", "s.*")


def _row(limit: int, overlap: int, model: Model) -> Callable[..., Iterator[tuple]]:
    def row(pos: int, text: str) -> Iterator[tuple]:
        inside = spans(text, model)
        found = cut(text, inside, limit, overlap)
        # Some cut, at a line's end, between words or in one, lies inside every sentence longer than the limit.
        broken = [s for s, e in inside if e - s > limit and any(s < a < e for _, _, a, _ in found)]
        yield pos, [dict(zip(("start_at", "end_at", "new_at", "cut_at"), p)) for p in found], broken

    return row


def _exploded(made: DataFrame, column: str) -> DataFrame:
    return made.select("pos", F.posexplode(column).alias("n", "p")).select("pos", "n", "p.*")
