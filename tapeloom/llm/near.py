"""Problem 3: near-duplicate records with small edits, by Golay-coded fingerprint segments.

A record is a set of features (runs of five words, or trigrams of a file name together with its numbers). Its fingerprint
is the least feature hash in each of 32 bins; a 46-bit piece of each minimum is two 23-bit segments, decoded to the index
of the nearest Golay codeword. Each ``width`` neighbouring bins give one key of their indices, so a record has 32 keys.
Pigeonhole: two records whose sets overlap by J disagree in about (1 - J) x 32 bins; unless those errors hit every
stretch of ``width`` bins, a key agrees. With two bins that fails for 2 pairs in 10,000 at J = 0.55, with four, as for file names, for some in 10,000 at 0.75.
Records that share a key are verified on their whole feature sets, unless sketches of the sets already show that they are too unlike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.components import components
from tapeloom.llm.golay import BITS, INDEX_BITS, decoded
from tapeloom.llm.rows import batched, each
from tapeloom.llm.words import common, hashed, mixed, runs_of, words
from tapeloom.plans.filtering import only_keys
from tapeloom.plans.stage import staged

BINS = 32
#: Texts of fewer words have no near-copies by definition.
LEAST_WORDS = 20
#: The records of a key that more than this have in common don't meet by the key but by their rarest features, which misses no pair at the threshold.
HOT_KEY = 200
#: Keys in a bucket, about, and in the stretch of rows that a task sorts at once: some 200 MB at work.
BUCKET_KEYS = 4_000_000
#: Sketches tell most unlike records apart at once, so that many times more of them meet by a key.
HOT_SKETCHED = 10
#: Bits of a key that are compared inside a bucket; equal bits of unlike keys only add candidates.
_KEY_BITS = 40
_SPREAD = pa.schema([("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("sketches", pa.binary())])

_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(59)
_SLOTS = mixed(np.arange(1, BINS + 1, dtype=np.uint64))
_MASK = np.uint64((1 << BITS) - 1)
_NUMBERS = regex.compile(r"\d+")
_NOT_PLAIN = regex.compile(r"[^a-z0-9]+")


def text_features(text: str | None) -> np.ndarray:
    """The distinct runs of a text of at least 20 words, ascending; else none."""
    tokens = words(text)
    return np.unique(runs_of(hashed(tokens))) if len(tokens) >= LEAST_WORDS else np.zeros(0, dtype=np.uint64)


def name_features(path: str | None) -> np.ndarray:
    """The distinct three-character pieces of a path's file name, each with the name's set of whole numbers; none if the plain name has under three characters."""
    if not path:
        return np.zeros(0, dtype=np.uint64)
    name = path.rsplit("/", 1)[-1]
    name = name.rsplit(".", 1)[0] if "." in name else name
    numbers = " ".join(sorted({n.lstrip("0") or "0" for n in _NUMBERS.findall(name)}))
    plain = _NOT_PLAIN.sub("", name.lower())
    return np.array(sorted({xxhash.xxh64_intdigest(f"{plain[i : i + 3]}|{numbers}") for i in range(len(plain) - 2)}), dtype=np.uint64)


def keys_of(sets: list[np.ndarray], width: int) -> np.ndarray:
    """The 32 keys, each from ``width`` neighbouring bins, of each of several non-empty ascending feature sets, a row a set."""
    least = np.stack([f[np.searchsorted(f, _STARTS) % len(f)] for f in sets])  # an empty bin takes the next filled one's minimum, round the end
    least = mixed(least)
    index = decoded(least & _MASK).astype(np.uint64) << np.uint64(INDEX_BITS) | decoded(least >> np.uint64(BITS) & _MASK).astype(np.uint64)
    keys = _SLOTS
    for i in range(width):
        keys = mixed(keys ^ np.roll(index, -i, axis=1))
    return keys.view(np.int64)


def sketch_of(f: np.ndarray, width: int) -> bytes:
    """``width`` x 64 bits, each the parity of the features whose hash falls on it: the bits two sketches differ in are at most the features only one of the sets has."""
    return np.packbits(np.bincount((f % np.uint64(max(1, 64 * width))).astype(np.intp), minlength=64 * width)[: 64 * width] & 1).tobytes()


def most_unlike(threshold: float) -> float:
    """Of two sets that reach ``threshold``, the features that only one of them has are at most so large a part of the sum of their sizes."""
    return (1 - threshold) / (1 + threshold)


def _marked(features_of: Callable[[str], np.ndarray], width: int, sketch: int) -> Callable[..., list[list]]:
    def rows(ids: list[int], texts: list[str]) -> list[list]:
        kept = [(i, f) for i, t in zip(ids, texts) if len(f := features_of(t))]
        same = [xxhash.xxh64_intdigest(f.tobytes()) - (1 << 63) for _, f in kept]
        return [[i for i, _ in kept], same, [len(f) for _, f in kept], list(keys_of([f for _, f in kept], width)) if kept else [], [sketch_of(f, sketch) for _, f in kept]]

    return rows


def _spread(buckets: int, most: int, sketch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, size, keys, sketch) rows to a row a bucket of keys: the keys in five bytes each, with ids, sizes and sketches.

    A key that more than ``most`` records of one stretch of rows have goes on with ``most`` + 1 of them, enough to show that it is hot; the
    stretch's records with such keys travel in a row without keys. So no bucket gets more of a key than ``most`` + 1 for each stretch.
    """

    def flushed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = table.column("keys").combine_chunks()
        keys, n = pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy()
        owner = np.repeat(np.arange(len(n)), n)
        ids, sizes = (table.column(c).combine_chunks().to_numpy() for c in ("id", "size"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(n), 8 * sketch)
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        kept = np.ones(len(keys), dtype=bool)
        kept[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[kept], owner[kept]
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        nth = np.arange(len(keys)) - np.repeat(first, counts)
        hot = np.unique(owner[np.repeat(counts > most, counts)])
        kept = nth <= most
        bits, owner = keys[kept].view(np.uint64), owner[kept]
        bucket = (bits >> np.uint64(_KEY_BITS)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bits, owner, bucket = bits[order], owner[order], bucket[order].astype(np.int32)
        five = np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8)[:, : _KEY_BITS // 8]
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)) if len(bucket) else np.zeros(0, dtype=np.int64)
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        made = [[int(b) for b in bucket[starts]], [ids[owner[x:y]] for x, y in zip(starts, ends)], [sizes[owner[x:y]] for x, y in zip(starts, ends)], [five[x:y].tobytes() for x, y in zip(starts, ends)], [sketches[owner[x:y]].tobytes() for x, y in zip(starts, ends)]]
        if len(hot):
            for c, v in zip(made, (int(ids[hot[0]] % buckets), ids[hot], sizes[hot], None, None)):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, _SPREAD)], schema=_SPREAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) * BINS >= BUCKET_KEYS:
                yield flushed(held)
                held = []
        if held:
            yield flushed(held)

    return run


def _meeting(threshold: float, most: int, sketch: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket's rows to (a, b), a < b, for ids with a key in common, sizes and sketches that allow for ``threshold``; to (id, NULL) for ids with a hot key."""

    def met(table: pa.Table) -> pa.Table:
        sent = table.filter(table.column("keys").is_null()).combine_chunks()
        table = table.filter(table.column("keys").is_valid()).combine_chunks()
        five = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.uint8).reshape(-1, _KEY_BITS // 8)
        wide = np.zeros((len(five), 8), dtype=np.uint8)
        wide[:, : _KEY_BITS // 8] = five
        keys = wide.view(np.int64).reshape(-1)
        ids, sizes = (pc.list_flatten(table.column(c)).to_numpy() for c in ("ids", "sizes"))
        sketches = np.frombuffer(b"".join(table.column("sketches").to_pylist()), dtype=np.uint64).reshape(len(keys), sketch)
        order = np.argsort(keys, kind="stable")
        keys, ids, sizes, sketches = keys[order], ids[order], sizes[order], sketches[order]
        _, counts = np.unique(keys, return_counts=True)
        counts = np.repeat(counts, counts)
        hot = np.unique(np.concatenate([ids[counts > most], pc.list_flatten(sent.column("ids")).to_numpy()]))
        cold = (counts > 1) & (counts <= most)
        keys, ids, sizes, sketches = keys[cold], ids[cold], sizes[cold], sketches[cold]
        found = [np.zeros((0, 2), dtype=np.int64)]
        at = np.arange(len(keys))
        for apart in range(1, most):
            at = at[at + apart < len(keys)]  # a row whose key goes on so far did so one row before
            at = at[keys[at] == keys[at + apart]]
            if not len(at):
                break
            # The features in common are at most the smaller set, those in either at least the larger.
            x, y = sizes[at], sizes[at + apart]
            i = at[np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9]
            unlike = np.bitwise_count(sketches[i] ^ sketches[i + apart]).sum(axis=1, dtype=np.int64)
            i = i[unlike <= most_unlike(threshold) * (sizes[i].astype(np.int64) + sizes[i + apart]) + 1e-9]
            found.append(np.stack([np.minimum(ids[i], ids[i + apart]), np.maximum(ids[i], ids[i + apart])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        ends = [np.concatenate([pairs[:, 0], hot]), np.concatenate([pairs[:, 1], hot])]
        alone = np.arange(len(ends[0])) >= len(pairs)
        return pa.table([pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64(), mask=alone)], names=["a", "b"])

    return met


def _hot(sketch: int) -> int:
    """The records that may meet by one key, at most."""
    return HOT_KEY * (HOT_SKETCHED if sketch else 1)


def _candidates(keys: DataFrame, rows: DataFrame, features_of: Callable[[str], np.ndarray], threshold: float, sketch: int) -> DataFrame:
    """(id, size, keys, sketch) rows, with the texts (id, text) they were made of, to distinct (a, b), a < b, of ids with a key in common.

    Keys meet in buckets, so many that one holds some BUCKET_KEYS of them; pairs whose sizes or sketches show that they can't reach ``threshold`` don't leave it.
    Records with a key that too many records share are left to ``_by_rare``, which misses none of their pairs at ``threshold``.
    """
    buckets = max(2 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-BINS * keys.count() // BUCKET_KEYS))
    spread = keys.select("id", "size", "keys", "sketch").mapInArrow(_spread(buckets, _hot(sketch), sketch), "bucket int, ids array<long>, sizes array<int>, keys binary, sketches binary")
    met = staged(spread.groupBy("bucket").applyInArrow(_meeting(threshold, _hot(sketch), sketch), "a long, b long"), "met")
    pairs = met.where("b IS NOT NULL").distinct()
    hot = met.where("b IS NULL").select(F.col("a").alias("id")).distinct()
    if hot.isEmpty():
        return pairs
    return pairs.unionByName(_by_rare(only_keys(rows, hot, "id"), features_of, threshold, sketch)).distinct()


def _by_rare(rows: DataFrame, features_of: Callable[[str], np.ndarray], threshold: float, sketch: int = 0) -> DataFrame:
    """(id, text) to (a, b), a < b: all pairs that may reach ``threshold``, exactly, however many records share a key.

    Two records at the threshold share at least ``threshold`` of either's features, so each has a shared one among its n - ceil(threshold n) + 1 rarest, by
    how many of ``rows`` hold them. What a third of the rows have in common is in no record's rarest ones, unless it is most of the record.
    A feature that many records still have there is joined in blocks of its records. Pairs whose sketches differ too much are left out.
    """

    def features(i: int, text: str) -> Iterator[tuple]:
        f = features_of(text)
        yield i, xxhash.xxh64_intdigest(f.tobytes()) - (1 << 63), f.view(np.int64).tolist(), np.frombuffer(sketch_of(f, sketch), dtype=np.int64).tolist()

    made = each(rows, "id long, same long, features array<long>, sketch array<long>", features)
    kinds = made.groupBy("id", "same").agg(F.first("features").alias("features"))
    flat = staged(kinds.select("id", "same", F.size("features").alias("size"), F.explode("features").alias("key")), "features")
    often = flat.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    shared = flat.join(often, "key")
    # Features of one record only come first: a record's others start behind them.
    of_id = Window.partitionBy("id", "same")
    place = F.row_number().over(of_id.orderBy("f", "key")) + F.col("size") - F.count("*").over(of_id)
    most = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)) + 1
    rare = staged(shared.withColumn("place", place).where(F.col("place") <= most).select("id", "same", "size", "key"), "rare")
    counted = rare.join(rare.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    counted = counted.join(made.groupBy("id", "same").agg(F.first("sketch").alias("sketch")), ["id", "same"]) if sketch else counted.withColumn("sketch", F.lit(None))
    blocks = F.ceil(F.col("n") / _hot(sketch)).cast("int")
    spread = counted.select("id", "size", "key", "sketch", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    left, right = spread.alias("l"), spread.alias("r")
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.own") == F.col("r.other")) & (F.col("l.other") == F.col("r.own")) & (F.col("l.id") < F.col("r.id")))
    met = met.where(F.least("l.size", "r.size") >= threshold * F.greatest("l.size", "r.size") - F.lit(1e-9))
    if sketch:
        unlike = sum((F.bit_count(F.col("l.sketch")[i].bitwiseXOR(F.col("r.sketch")[i])) for i in range(sketch)), F.lit(0))
        met = met.where(unlike <= F.lit(most_unlike(threshold)) * (F.col("l.size") + F.col("r.size")) + F.lit(1e-9))
    return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def similar(df: DataFrame, key: str, text: str, features_of: Callable[[str], np.ndarray], threshold: float, width: int, sketch: int = 0) -> tuple[DataFrame, DataFrame]:
    """Near-copies among the rows of ``df``: (members, links).

    members (id, rep): every row with features; rows with the same features have the least id among them as ``rep``.
    links (a, b, jaccard): representatives a < b whose features in common are at least ``threshold`` of the features in either.
    Rows with a NULL key or text, or too short for features, are in neither. A repeated row counts once; a key with
    several texts counts with each. Columns beside ``key`` and ``text`` are not read. ``sketch`` x 64 bits a record, see
    ``sketch_of``, keep unlike pairs with a common key from being verified; best some three bits a feature.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    marks = staged(batched(rows, "id long, same long, size int, keys array<long>, sketch binary", _marked(features_of, width, sketch)), "marks")
    reps = marks.groupBy("same").agg(F.min("id").alias("rep"), F.max("size").alias("size"), F.min_by("keys", "id").alias("keys"), F.max("sketch").alias("sketch"))
    members = marks.select("id", "same").distinct().join(marks.groupBy("same").agg(F.min("id").alias("rep")), "same").select("id", "rep")
    reps = reps.select(F.col("rep").alias("id"), "size", "keys", "sketch")
    pairs = staged(_candidates(reps, rows, features_of, threshold, sketch), "pairs")
    rows = only_keys(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")

    kept: list[Callable[[str], np.ndarray]] = []  # made in each task: features of the texts of its last pairs, as a text is often in several

    def verified(a: int, b: int, one: str, other: str) -> Iterator[tuple]:
        if not kept:
            kept.append(lru_cache(maxsize=1024)(features_of))
        x, y = kept[0](one), kept[0](other)
        both = common(x, y)
        if both and both >= threshold * (len(x) + len(y) - both):
            yield a, b, both / (len(x) + len(y) - both)

    with_a = pairs.join(rows.withColumnsRenamed({"id": "a", "text": "one"}), "a")
    with_b = with_a.join(rows.withColumnsRenamed({"id": "b", "text": "other"}), "b").select("a", "b", "one", "other")
    links = each(with_b, "a long, b long, jaccard double", verified).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    return members, links


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair (pos_a, pos_b) of rows, pos_a < pos_b, copies included, that the links and the copies stand for."""
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    copies = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("pos_a"), F.greatest("x", "y").alias("pos_b")).where("pos_a < pos_b").distinct()


def classes_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(pos, class_id, links): each row's class, named by its least row, and the representatives its own is linked with."""
    marked = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        members.join(marked.withColumnsRenamed({"vertex": "rep"}), "rep", "left")
        .join(degree, "rep", "left")
        .groupBy(F.col("id").alias("pos"))
        .agg(F.min(F.coalesce("component", "rep")).alias("class_id"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    )
