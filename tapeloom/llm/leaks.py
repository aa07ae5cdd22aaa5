"""Problem 8: evaluation texts inside training text, by greedy string tiling.

The items' runs of five words are the seeds, joined with the documents' runs. A document that holds enough seeds of an item is tiled with it: again and
again the longest match between words that no tile covers yet is marked, found by running Karp-Rabin hashes over windows that shrink. Tiles may
lie in any order, so passages that were reordered count in full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.rows import each
from tapeloom.llm.words import RUN, common, hashed, runs_of, words
from tapeloom.plans.filtering import only_keys
from tapeloom.plans.stage import staged

SHARE = 0.4
#: Bits, as a power of two, of the filter that keeps documents' runs which no item holds out of the join: 8 MB. More items only fill it.
FILTER_BITS = 26
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def _windows(h: list[int], free: list[bool], size: int) -> dict[int, list[int]]:
    """Places of the windows of ``size`` unmarked words by their Karp-Rabin hash, rolled from one to the next."""
    found: dict[int, list[int]] = defaultdict(list)
    top, value, length = pow(_BASE, size - 1, _PRIME), 0, 0
    for i, x in enumerate(h):
        if not free[i]:
            value = length = 0
            continue
        if length == size:
            value = (value - h[i - size] * top) % _PRIME
            length -= 1
        value = (value * _BASE + x) % _PRIME
        length += 1
        if length == size:
            found[value].append(i - size + 1)
    return found


def _seeded(a: list[int], b: list[int]) -> list[bool]:
    """Whether each word of ``a`` is in a run that stands in ``b`` too."""
    here, there = runs_of(np.array(a, dtype=np.uint64)), runs_of(np.array(b, dtype=np.uint64))
    inside = np.zeros(len(a) + RUN, dtype=np.int64)
    at = np.flatnonzero(np.isin(here, there))
    np.add.at(inside, at, 1)
    np.add.at(inside, at + RUN, -1)
    return (np.cumsum(inside)[: len(a)] > 0).tolist()


def _longest(free: list[bool]) -> int:
    """The length of the longest stretch of unmarked words."""
    most = now = 0
    for f in free:
        now = now + 1 if f else 0
        most = max(most, now)
    return most


def tiles(a: list[int], b: list[int], least: int = RUN, first: int = 64) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the tiles of two hashed word sequences, the longest first; no word is in two tiles.

    Windows of ``first`` words are looked for first. Where a match reaches twice the window, the search starts anew
    with its length; else the window is halved, down to ``least``. Words in no shared run of five are in no tile of five and are left out from the start.
    """
    free_a, free_b = _seeded(a, b), _seeded(b, a)
    if least < RUN:
        free_a, free_b = [True] * len(a), [True] * len(b)
    found: list[tuple[int, int, int]] = []
    size = max(least, min(first, _longest(free_a), _longest(free_b)))
    while True:
        places = _windows(b, free_b, size)
        matches: list[tuple[int, int, int]] = []
        longer = 0
        for value, starts in (_windows(a, free_a, size).items() if places else ()):
            for i in starts:
                for j in places.get(value, ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                        n += 1
                    if n >= size:
                        matches.append((n, i, j))
                        longer = max(longer, n)
        if longer > 2 * size:
            size = longer
            continue
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
                found.append((i, j, n))
        if size == least:
            return found
        size = max(least, min(size // 2, _longest(free_a), _longest(free_b)))


def _seeds(item: int, text: str) -> Iterator[tuple]:
    """Of an item: each distinct run, how often it stands in the item, and the item's distinct runs and words."""
    h = hashed(words(text))
    kinds, times = np.unique(runs_of(h), return_counts=True)
    for run, n in zip(kinds.view(np.int64).tolist(), times.tolist()):
        yield item, xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63), run, n, len(kinds), len(h)


def _filter(seeds: DataFrame) -> np.ndarray:
    """The bits that any seed sets, packed. Whatever the seeds, no more than 2^FILTER_BITS bits come to the driver, as at most 2^(FILTER_BITS - 6) words."""
    slot = F.shiftrightunsigned("run", 64 - FILTER_BITS)
    one = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    held = seeds.select(slot.alias("slot")).withColumn("one", one).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(one)").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[held["at"].to_numpy(dtype=np.int64)] = held["bits"].to_numpy(dtype=np.int64)
    return bits


def _met(docs: DataFrame, seeds: DataFrame, least_tiled: float, share: float) -> DataFrame:
    """(doc, item): the pairs that may be leaks, by the runs of the item that stand in the document.

    Pairs stay that share ``share`` of the item's distinct runs, or of which the runs met, each as often as it stands in the item and of five words, can
    cover ``least_tiled`` of the item's words. Runs of documents that no item holds are left out before the join by a filter of bounded size.
    """
    bits, low = docs.sparkSession.sparkContext.broadcast(_filter(seeds)), np.uint64(64 - FILTER_BITS)

    def runs(doc: int, text: str) -> Iterator[tuple]:
        kinds = np.unique(runs_of(hashed(words(text))))
        at = (kinds >> low).astype(np.int64)
        kinds = kinds[(bits.value[at >> 6] >> (at & 63)) & 1 == 1]
        if len(kinds):
            yield doc, kinds.view(np.int64).tolist()

    held = each(docs, "doc long, runs array<long>", runs, rows=2048).select("doc", F.explode("runs").alias("run")).distinct()
    met = held.join(seeds, "run").groupBy("doc", "item", "same", "n_runs", "n_words").agg(F.count("*").alias("n"), F.sum("times").alias("times"))
    may = (F.col("n") >= share * F.col("n_runs") - F.lit(1e-9)) | (RUN * F.col("times") >= least_tiled * F.col("n_words") - F.lit(1e-9))
    return met.where(may).select("doc", "item").distinct()


def leaks(docs: DataFrame, items: DataFrame, least_tiled: float = 0.25, share: float = SHARE, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, tiled, runs_shared, n_tiles, longest): documents and the items that leaked into them.

    A pair is in the result if tiles cover ``least_tiled`` of the item's words, or ``share`` of its distinct runs stand in the document, in whatever order and
    however little the tiles cover. ``tiled`` is the share of the item's words in tiles of at least five words, ``runs_shared`` that of its
    distinct runs. NULL keys and texts, and items under five words, are in no row. Repeated rows count once; a key with several texts
    counts with the one that leaked most. Items may be as many as documents: nothing of them is collected but a filter of 2^FILTER_BITS bits.
    """
    wanted = items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(F.col(item_key).cast("long").alias("item"), F.col(text).alias("passage")).distinct()
    rows = docs.select(F.col(doc_key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    seeds = staged(each(wanted, "item long, same long, run long, times int, n_runs int, n_words int", _seeds).distinct(), "seeds")
    met = staged(_met(rows, seeds, least_tiled, share), "met")
    documents = only_keys(rows, met.select("doc").distinct(), "doc").distinct()
    pairs = met.join(documents, "doc").join(wanted, "item").select("doc", "item", "text", "passage")
    kept: list[Callable[[str], list[int]]] = []  # made in each task: the words of its last texts, as a text is often in several pairs

    def tiled(doc: int, item: int, document: str, passage: str) -> Iterator[tuple]:
        if not kept:
            kept.append(lru_cache(maxsize=256)(lambda t: hashed(words(t)).tolist()))
        b, a = kept[0](document), kept[0](passage)
        x, y = np.unique(runs_of(np.array(a, dtype=np.uint64))), np.unique(runs_of(np.array(b, dtype=np.uint64)))
        if not len(x) or not (both := common(x, y)):
            return
        found = tiles(a, b)
        covered = sum(t for _, _, t in found)
        if covered >= least_tiled * len(a) or both >= share * len(x) - 1e-9:
            yield doc, item, covered / len(a), both / len(x), len(found), max(t for _, _, t in found)

    found = each(pairs, "doc_id long, item_id long, tiled double, runs_shared double, n_tiles int, longest int", tiled)
    best = F.max(F.struct("runs_shared", "tiled", "n_tiles", "longest")).alias("s")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "s.tiled", "s.runs_shared", "s.n_tiles", "s.longest")
