"""Copies and near-copies by lines. A copy is grouped by a digest of its text with partial aggregation: no task holds all copies of a text."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import text as X
from tapeloom.plans.stage import staged

#: Lines of a difference, headers and context included, from which two texts are no near-copies.
DIFF_LINES = 10
#: A difference under DIFF_LINES changes at most so many lines.
CHANGED = 6
#: Texts of over 7 lines with a line that more than this many texts have among their rarest meet by two lines together instead of by the one.
HOT_MARK = 200
#: What a repetition of a line adds to its hash.
_REPEATED = np.uint64(0x9E3779B97F4A7C15)


def copies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(kept, removed): every later copy of a text with the least key that has it. NULL texts are no copies."""
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("removed"), F.md5(text).alias("d"), F.length(text).alias("n")).distinct()
    first = rows.groupBy("d", "n").agg(F.min("removed").alias("kept"), F.count("*").alias("c")).where("c > 1")
    return rows.join(first, ["d", "n"]).where("removed <> kept").select("kept", "removed")


def first_of_each(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of every value of the string ``by``; the columns are these and ``by``. Values are grouped by digest and length."""
    kept = df.groupBy(F.md5(by).alias("_d"), F.length(by).alias("_n")).agg(F.min(F.struct(*order, by)).alias("_k"))
    return kept.select(*(f"_k.{c}" for c in (by, *order)))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key comes more than once, with its count as ``n``."""
    often = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(often, key)


def _listed(df: DataFrame, key: str) -> DataFrame:
    """One row (id, lines, n, text) for each distinct text: the least key that has it."""
    rows = df.where(F.col(key).isNotNull() & F.col("text").isNotNull())
    first = rows.groupBy(F.md5("text").alias("d"), F.length("text").alias("c")).agg(F.min(key).alias("id"), F.first("text").alias("text"))
    listed = X.shown_lines("text")
    return first.select("id", listed.alias("lines"), F.size(listed).cast("long").alias("n"))


def short_links(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, n_lines, links): of each distinct text of at most 6 lines, how many other texts make at most 6 lines with it.

    Two such texts differ by under ten diff lines whatever they say, so links are counted by length, not made.
    """
    texts = _listed(df, key).where(F.col("n") <= CHANGED).select("id", "n")
    sizes = texts.groupBy("n").agg(F.count("*").alias("c"))
    reach = sizes.select(F.col("n").alias("m"), "c")  # at most 7 rows
    per = sizes.select("n").join(F.broadcast(reach), F.col("n") + F.col("m") <= CHANGED, "left").groupBy("n").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("links"))
    own = F.when(2 * F.col("n") <= CHANGED, 1).otherwise(0)
    return texts.join(F.broadcast(per), "n").select("id", F.col("n").alias("n_lines"), (F.col("links") - own).alias("links"))


def _marked(texts: DataFrame) -> DataFrame:
    """(id, n, marks): a number for each line of a text, another one for each of its repetitions. No line leaves its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            h, owner, i = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n), np.arange(int(n.sum()))
            order = np.lexsort((h, owner))
            h = h[order]
            # Equal lines of a text stand together now; a repetition is the distance from the first of them.
            first = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
            nth = i - np.maximum.accumulate(np.where(first, i, 0)) if len(h) else i
            marks = pa.array((h.view(np.uint64) + nth.astype(np.uint64) * _REPEATED).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), marks)], names=["id", "n", "marks"])

    rows = texts.select(F.col("id").cast("long").alias("id"), "n", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))
    return rows.mapInArrow(run, "id long, n long, marks array<long>")


def _meeting(one: DataFrame, other: DataFrame) -> DataFrame:
    """(a, b, na, nb), a < b: of two tables (id, n, mark) the texts with a mark in common whose lengths allow for a difference of 6 lines."""
    a, b = one.alias("a"), other.alias("b")
    met = a.join(b, (F.col("a.mark") == F.col("b.mark")) & (F.col("a.id") != F.col("b.id")) & (F.abs(F.col("a.n") - F.col("b.n")) <= CHANGED) & (F.col("a.n") + F.col("b.n") > CHANGED))
    first = F.col("a.id") < F.col("b.id")
    ends = [F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(n) for x, y, c, n in (("a", "b", "id", "a"), ("b", "a", "id", "b"), ("a", "b", "n", "na"), ("b", "a", "n", "nb"))]
    return met.select(*ends).distinct()


def _candidates(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct texts of over 6 lines together that may differ in at most 6 lines.

    Each text misses at most 6 of the other's lines, so of its 7 rarest lines (each repetition a line of its own) the other has
    one; both have it among their own 7 rarest. No other lines are joined on, and of lines that many texts have two together.
    """
    marked = _marked(texts).select("id", "n", F.explode("marks").alias("mark"))
    often = marked.groupBy("mark").agg(F.count("*").alias("f")).where("f > 1")
    shared = staged(marked.join(often, "mark", "left").withColumn("f", F.coalesce("f", F.lit(1))), "marks")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("f", "mark"))
    rare = staged(shared.withColumn("r", rank).where((F.col("r") <= CHANGED + 2) & (F.col("f") > 1)).select("id", "n", "mark", "r"), "rare")
    prefix = rare.where(F.col("r") <= CHANGED + 1)
    held = prefix.groupBy("mark").agg(F.count("*").alias("held"))
    cold = prefix.join(held.where((F.col("held") > 1) & (F.col("held") <= HOT_MARK)), "mark").select("id", "n", "mark")
    pairs = _meeting(cold, cold)
    hot = prefix.join(held.where(F.col("held") > HOT_MARK), "mark").select("id", "n", "mark")
    if not hot.isEmpty():
        # Of two texts of over 7 lines each the two rarest common lines are among both's 8 rarest: they meet by these two.
        long = rare.where(F.col("n") > CHANGED + 1).join(hot.select("id").distinct(), "id").groupBy("id", "n").agg(F.array_sort(F.collect_list("mark")).alias("m"))
        two = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, CHANGED + 2), lambda y: F.xxhash64(x, y))))
        by_two = long.select("id", "n", F.explode(two).alias("mark"))
        short = hot.where(F.col("n") <= CHANGED + 1)
        either = _meeting(short, hot)
        pairs = pairs.unionByName(_meeting(by_two, by_two)).unionByName(either).distinct()
    left, right = shared.select(F.col("id").alias("a"), "mark"), shared.select(F.col("id").alias("b"), F.col("mark").alias("mark"))
    both = pairs.join(left, "a").join(right, ["b", "mark"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return both.where(F.col("na") + F.col("nb") - 2 * F.col("common") <= CHANGED).select("a", "b", (F.col("na") + F.col("nb") - 2 * F.col("common")).alias("apart"))


def near_candidates(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(a, b, apart): pairs of distinct texts, over 6 lines together, with at most 6 lines not in common."""
    return _candidates(staged(_listed(df, key), "listed"))


def near_copies(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(a, b, n_diff, n_back): of the candidates those whose unified difference, in either direction, has under ten lines."""
    texts = staged(_listed(df, key), "listed")
    pairs = _candidates(texts).select("a", "b")
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("lines").alias("x")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("lines").alias("y")), "b").select("a", "b", "x", "y")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            there = [len(list(difflib.unified_diff(p, q, lineterm=""))) for p, q in zip(x, y)]
            back = [len(list(difflib.unified_diff(q, p, lineterm=""))) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_diff": pa.array(there, pa.int64()), "n_back": pa.array(back, pa.int64())})

    made = both.mapInArrow(compared, "a long, b long, n_diff long, n_back long")
    return made.where(f"(n_diff > 0 AND n_diff < {DIFF_LINES}) OR (n_back > 0 AND n_back < {DIFF_LINES})")
