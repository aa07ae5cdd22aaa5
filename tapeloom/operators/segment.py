"""Separators, blocks and paragraphs of line lists; each text is a line list of its own.

A text's lines stay in one row, as an array, until the result is known: nothing is shuffled by text or sorted back by line. Batches of such
rows are gone through as flat arrays. All operators take texts (pos, text), or lines (pos, line_no, line), which are gathered by ``pos`` first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tapeloom.functions import text as X


class Flat:
    """The lines of a batch of texts, one after the other."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column(1)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.pos, self.lines, self.total = batch.column(0), lists.flatten(), int(n.sum())
        self.text = np.repeat(np.arange(len(n)), n)
        self.first = np.repeat(np.cumsum(n) - n, n)
        self.at = np.arange(self.total) - self.first
        self.last = self.at == np.repeat(n, n) - 1
        self.blank = pc.equal(self.lines, "").to_numpy(zero_copy_only=False).astype(bool)

    def running(self, x: np.ndarray) -> np.ndarray:
        """The sum of ``x`` over each text's lines so far, this one included."""
        total = np.cumsum(x)
        return total - (total - x)[self.first] if len(x) else total

    def blanks(self) -> np.ndarray:
        """How many blank lines in a row end at each line; 0 for text."""
        i = np.arange(self.total)
        text = np.maximum.accumulate(np.where(~self.blank, i, np.where(self.at == 0, i - 1, -1))) if self.total else i
        return i - text

    def taken(self, where: np.ndarray, *columns: np.ndarray) -> list:
        """The keys of the chosen lines' texts, and what belongs to the lines."""
        return [self.pos.take(pa.array(self.text[where])), *(c[where] for c in columns)]


def _by_text(df: DataFrame, schema: str, make: Callable[[Flat], list]) -> DataFrame:
    """``make`` gets the lines of a batch of texts and returns the result's columns."""
    if "text" in df.columns:
        rows = df.where("text IS NOT NULL").select(F.col("pos").cast("long").alias("pos"), X.lines("text").alias("l"))
    else:
        in_order = F.array_sort(F.collect_list(F.struct("line_no", "line")))
        rows = df.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.transform(in_order, lambda x: x["line"]).alias("l"))
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(make(Flat(b)), target)], schema=target)

    return rows.mapInArrow(run, schema)


def block_starts(texts: DataFrame) -> DataFrame:
    """(pos, start_line): the line, from 1, after every second blank line, blanks counted on through text; line 0 is passed over."""

    def make(t: Flat) -> list:
        blank = t.blank & (t.at >= 1)
        return t.taken(blank & (t.running(blank.astype(np.int64)) % 2 == 0), t.at + 2)

    return _by_text(texts, "pos long, start_line long", make)


def block_assign(texts: DataFrame) -> DataFrame:
    """(pos, block_no, line_no, line): text lines with the number of blank pairs before them, where there is any."""

    def make(t: Flat) -> list:
        block = t.running((t.blank & (t.at >= 1)).astype(np.int64)) // 2
        where = ~t.blank & (t.at >= 1) & (block >= 1)
        return [*t.taken(where, block, t.at), t.lines.filter(pa.array(where))]

    return _by_text(texts, "pos long, block_no long, line_no long, line string", make)


def block_split(texts: DataFrame) -> DataFrame:
    """(pos, block_no, n_lines, n_text): blocks closed by two blank lines in a row; single blanks count as lines only."""

    def make(t: Flat) -> list:
        # Every second line of a run of blank lines closes a block and is its last line.
        closing = (t.blank & (t.blanks() % 2 == 0)).astype(np.int64)
        block = t.running(closing) - closing
        begins = np.flatnonzero((t.at == 0) | np.append(0, closing[:-1]).astype(bool)) if t.total else np.zeros(0, dtype=np.int64)
        lines = np.diff(np.append(begins, t.total))
        text = np.add.reduceat((~t.blank).astype(np.int64), begins) if len(begins) else lines
        return [*t.taken(begins, block), lines, text]

    return _by_text(texts, "pos long, block_no long, n_lines long, n_text long", make)


def block_literal(df: DataFrame) -> DataFrame:
    """(pos, block_no, block): what stands between two blank lines, taken literally; what stands before the first is dropped."""
    cut = df.select("pos", F.posexplode(F.split(X.unix_lines("text"), "\n\n\n", -1)).alias("n", "block"))
    return cut.where("n >= 1").select("pos", F.col("n").cast("long").alias("block_no"), "block")


def separator_check(texts: DataFrame) -> DataFrame:
    """(pos, line_no, flag): text after exactly one blank line ('a'), or after exactly two but not indented ('b')."""

    def make(t: Flat) -> list:
        before = np.where(t.at == 0, 0, np.append(0, t.blanks()[:-1])) if t.total else t.at
        indented = pc.starts_with(t.lines, " ").to_numpy(zero_copy_only=False).astype(bool)
        where = ~t.blank & ((before == 1) | ((before == 2) & ~indented))
        return t.taken(where, t.at, np.where(before == 1, "a", "b"))

    return _by_text(texts, "pos long, line_no long, flag string", make)


def single_lines(texts: DataFrame) -> DataFrame:
    """(pos, line_number): text lines, from 1, between blank lines; the start of a text counts as blank, its end doesn't."""

    def make(t: Flat) -> list:
        before = (t.at == 0) | np.append(False, t.blank[:-1])[: t.total]
        after = ~t.last & np.append(t.blank[1:], False)[: t.total]
        return t.taken(~t.blank & before & after, t.at + 1)

    return _by_text(texts, "pos long, line_number long", make)
