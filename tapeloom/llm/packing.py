"""Problem 1: filling fixed-capacity containers, with lower bounds that certify the result.

Items are spread over parts by hash. In each part best-fit decreasing packs them, and dual feasible functions give a lower bound on
the bins any packing needs; a part whose bins equal its bound is certified and closed. The other parts keep their full bins
and give the documents of the rest away: four parts each pool them, and best-fit decreasing runs again; the new packing is
taken where it needs fewer bins. Only sizes travel, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.plans.stage import staged

CAPACITY = 768
#: Items a part is meant to hold; parts are packed each in one task.
PART_ITEMS = 20_000
ROUNDS = 2
_POOL = 4


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each item. Every size is at most ``capacity``; items of size 0 go into the first bin."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    some = 0  # bit r is set where room[r] isn't empty
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            b, left = used, capacity
            used += 1
        bins[i] = b
        room[left - size].append(b)
        some |= 1 << (left - size)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The most that dual feasible functions prove: no packing of ``sizes`` has fewer bins."""
    return bound_of(np.bincount(sizes, minlength=capacity + 1)[: capacity + 1], capacity)


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """The same of how many items there are of each size from 0 to ``capacity``.

    Taken over f(x) = x, the threshold functions (sizes over capacity - e count whole, under e not at all) and the
    rounding functions u_k(x), for k up to 20.
    """
    counts = counts.astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ x) // capacity)
    ahead, mass = np.concatenate([np.cumsum(counts), [0]]), np.concatenate([np.cumsum(counts * x), [0]])
    total = int(counts.sum())
    for e in range(1, capacity // 2 + 1):
        whole = total - int(ahead[capacity - e])
        middle = int(mass[capacity - e]) - int(mass[e - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * x
        u = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int(counts @ u) // (k * capacity)))
    return best if total else 0


def _first(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"]).reset_index(drop=True)
        sizes = pdf["size"].to_numpy()
        pdf["bin"] = best_fit(sizes, capacity)
        pdf["closed"] = bool(pdf["bin"].max() + 1 == max(1, lower_bound(sizes, capacity)))
        return pdf

    return pack


def _again(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="pool").sort_values(["id", "piece"]).reset_index(drop=True)
        sizes = pdf["size"].to_numpy()
        old = pdf.groupby(["part", "bin"], sort=True).ngroup().to_numpy()
        new = best_fit(sizes, capacity)
        bound = max(1, lower_bound(sizes, capacity))
        chosen = new if new.max() < old.max() else old
        # Bins of a pool are named by the pool, below zero so that they never meet the bins a part kept.
        pdf["bin"] = -1 - chosen
        pdf["part"] = int(pdf["part"].min())
        pdf["closed"] = bool(chosen.max() + 1 == bound)
        return pdf

    return pack


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, offset, size, part, bin, closed): the pieces with the bin of a part that each is in; ``closed`` parts are certified."""
    schema = "id long, piece long, offset long, size long, part long, bin long, closed boolean"
    one = items.where("id IS NOT NULL").groupBy("id").agg(F.greatest(F.coalesce(F.max("size").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("long")
    cut = one.select("id", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("p", "piece"))
    cut = cut.select("id", "piece", (F.col("piece") * capacity).alias("offset"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).alias("size"))
    cut = staged(cut, "items")
    parts = max(1, round(cut.count() / PART_ITEMS))
    rows = cut.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts))).withColumn("bin", F.lit(0).cast("long")).withColumn("closed", F.lit(False))
    rows = staged(rows.groupBy("part").applyInPandas(_first(capacity), schema), "packed")
    for turn in range(ROUNDS):
        if parts == 1 or rows.where("NOT closed").isEmpty():
            break
        filled = F.sum("size").over(Window.partitionBy("part", "bin"))
        marked = rows.withColumn("open", ~F.col("closed") & (filled < capacity))
        pool = F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(max(1, parts // _POOL)))
        given = marked.where("open").drop("open").withColumn("pool", pool)
        repacked = given.groupBy("pool").applyInPandas(_again(capacity), schema)
        # Names of this round's bins are kept apart from the earlier rounds' by a step that no pool's number of bins reaches.
        step = (turn + 1) << 40
        repacked = repacked.withColumn("bin", F.col("bin") - F.lit(step))
        rows = staged(marked.where("NOT open").drop("open").unionByName(repacked), "packed")
    return rows


def certificates(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(part, pieces, bins, bound, certified): of each part its bins beside the number that dual feasible functions prove any packing of it needs."""

    def held(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, bound = pdf["bin"].nunique(), max(1, lower_bound(pdf["size"].to_numpy(), capacity))
        return pd.DataFrame([[int(pdf["part"].iloc[0]), len(pdf), bins, bound, bins == bound]], columns=["part", "pieces", "bins", "bound", "certified"])

    return _packed(items, capacity).select("part", "bin", "size").groupBy("part").applyInPandas(held, "part long, pieces long, bins long, bound long, certified boolean")


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (id BIGINT, size BIGINT) to (id, piece, offset, size, container, place): where each piece of each item lies.

    An item of at most ``capacity`` is one piece and is never split; a larger one is cut into whole containers and a rest.
    ``offset`` is where the piece begins inside its item; ``container`` counts from 0 without gaps, ``place`` orders the pieces
    in it. Items with a NULL id are left out; a NULL or negative size counts as 0; an id that comes several times is taken once, with its largest size.
    """
    rows = _packed(items, capacity)
    bins = rows.select("part", "bin").distinct()
    per_part = bins.groupBy("part").agg(F.count("*").alias("n"))
    before = per_part.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    numbered = bins.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("bin")) - 1).join(before, "part")
    numbered = numbered.select("part", "bin", (F.col("before") + F.col("rank")).alias("container"))
    placed = rows.join(numbered, ["part", "bin"])
    place = F.row_number().over(Window.partitionBy("container").orderBy("id", "piece")) - 1
    return placed.select("id", "piece", "offset", "size", "container", place.alias("place"))


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, size): the whitespace-separated words of every text; NULL and blank texts have none."""
    words = F.size(F.filter(F.split(F.col(text), r"(?U)[\s\x{1c}-\x{1f}]+"), lambda w: w != ""))
    return df.select(F.col(key).cast("long").alias("id"), F.when(F.col(text).isNull(), 0).otherwise(words).cast("long").alias("size"))


def samples(df: DataFrame, key: str = "pos", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Packs the texts of ``df`` by words; see ``packed``. Blank texts take a place of size 0, so that every record has one."""
    return packed(word_counts(df, key, text), capacity)


def volume(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(items, words, volume_bound): what is to be packed, and the containers it needs by volume alone."""
    one = items.where("id IS NOT NULL").groupBy("id").agg(F.greatest(F.coalesce(F.max("size"), F.lit(0)), F.lit(0)).alias("size"))
    a = one.agg(F.count("id").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("words"))
    return a.select("items", "words", F.ceil(F.col("words") / capacity).cast("long").alias("volume_bound"))


def summary(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, proven_bound, unused_share): how full the containers are, and the least number that dual feasible functions prove for all pieces together.

    Only how many pieces there are of each size, a row a size, comes to the driver.
    """
    placed = staged(placed.select("container", "size"), "placed")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in placed.groupBy("size").count().collect():
        counts[r["size"]] = r["count"]
    a = placed.agg((F.coalesce(F.max("container") + 1, F.lit(0))).cast("long").alias("containers"), F.sum("size").alias("words"))
    unused = F.when(F.col("containers") > 0, 1 - F.col("words") / (F.col("containers") * capacity))
    return a.select("containers", F.lit(bound_of(counts, capacity)).cast("long").alias("proven_bound"), unused.alias("unused_share"))
