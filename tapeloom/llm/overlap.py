"""Problem 5: records that stand in evaluation splits and, exactly or almost, in the training split; chunks say how alike they are.

Candidates are found by runs of five words, and none is missed: of an evaluation record's n distinct runs a training record must hold
``need``, 0.6 n rounded up. So a record of which training as a whole holds fewer has no pair; of one with ``seen`` runs in training each
pair shares 1 + k at least of any ``seen - need + 1 + k`` of them, and the rarest in training are looked up. Nothing is left out for being common,
repeated or short. Candidates are measured on their whole sets of runs.

The runs of both sides meet in buckets by hash, 40 bits each, packed by batch; equal bits of unlike runs only add candidates. A rolling hash
over two neighbouring words cuts a text's words into chunks; of a pair the share of the record's words in common chunks is given too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.rows import batched, each
from tapeloom.llm.words import common, hashed, mixed, runs_of, words
from tapeloom.plans.filtering import only_keys
from tapeloom.plans.stage import staged

LEAST_WORDS, SHARE = 20, 0.6
#: Words in a chunk on average.
CHUNK_WORDS = 6
#: Shorter chunks are not counted: hundreds of unrelated records share them.
LEAST_CHUNK = 3
#: Bits of a run's hash that are compared inside a bucket.
_BITS = 40
#: One run for so many that are needed is looked up beside, and needed of those looked up: fewer pairs by chance, none fewer of the true.
_MORE = 4
#: Runs in a bucket, about: some 200 MB at work.
BUCKET_RUNS = 4_000_000
#: Training records in a row of those that hold a run.
_HOLDERS = 4096

_FIRST, _SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def split_name(c: str) -> Column:
    """A split's name in lower case without blanks at the ends; ``val`` stands for validation."""
    low = F.lower(F.trim(c))
    return F.when(low == "val", "validation").otherwise(low)


def chunks(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(digests, lengths in words) of the distinct content-defined chunks of at least three words of a word sequence."""
    h = hashed(tokens)
    if not len(h):
        return h, np.zeros(0, dtype=np.int64)
    rolled = mixed(h[:-1] * _FIRST + h[1:] * _SECOND)
    ends = np.flatnonzero(rolled % np.uint64(CHUNK_WORDS) == 0) + 2
    starts = np.unique(np.concatenate([[0], ends[ends < len(h)]]))
    # A chunk's digest doesn't depend on where it stands: powers count from the chunk's own start.
    at = np.arange(len(h), dtype=np.uint64) - np.repeat(starts, np.diff(np.concatenate([starts, [len(h)]]))).astype(np.uint64)
    digests = mixed(np.add.reduceat(mixed(h + at * _FIRST), starts))
    lengths = np.diff(np.concatenate([starts, [len(h)]]))
    long = lengths >= LEAST_CHUNK
    digests, first = np.unique(digests[long], return_index=True)
    return digests, lengths[long][first]


def _digest(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(tokens)) - (1 << 63)


def _named(ids: list[int], evals: list[bool], texts: list[str]) -> list[list]:
    found = [(i, e, _digest(t), len(t)) for i, e, text in zip(ids, evals, texts) if len(t := words(text)) >= LEAST_WORDS]
    return [list(c) for c in zip(*found)] or [[], [], [], []]


def _packed(buckets: int) -> Callable[..., list[list]]:
    """A batch's distinct runs, a row a bucket and side: the records' digests, how many runs each has in the bucket, and the runs in five bytes each."""

    def rows(evals: list[bool], texts: list[str]) -> list[list]:
        sides: dict[bool, dict[int, np.ndarray]] = {True: {}, False: {}}
        for e, text in zip(evals, texts):
            if len(t := words(text)) >= LEAST_WORDS and (d := _digest(t)) not in sides[e]:
                sides[e][d] = np.unique(runs_of(hashed(t)))
        out: list[list] = [[], [], [], [], []]
        for e, sets in sides.items():
            if not sets:
                continue
            runs = np.concatenate(list(sets.values()))
            owner = np.repeat(np.array(list(sets), dtype=np.int64), [len(r) for r in sets.values()])
            bucket = ((runs >> np.uint64(_BITS)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            runs, owner, bucket = runs[order], owner[order], bucket[order]
            five = np.ascontiguousarray(runs).view(np.uint8).reshape(-1, 8)[:, : _BITS // 8]
            ends = [*(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for x, y in zip([0, *ends], ends):
                first = np.flatnonzero(np.diff(owner[x:y], prepend=~owner[x]))
                for c, v in zip(out, (int(bucket[x]), e, owner[x:y][first], np.diff(first, append=y - x).astype(np.int32), five[x:y].tobytes())):
                    c.append(v)
        return out

    return rows


def _met(table: pa.Table) -> pa.Table:
    """Of a bucket: each evaluation record's runs that training holds, with the number of training records that do; and the holders of each such run."""
    high = table.column("bucket")[0].as_py() << _BITS
    sides: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
    for e in (True, False):
        part = table.filter(pc.equal(table.column("eval"), e)).combine_chunks()
        five = np.frombuffer(b"".join(part.column("runs").to_pylist()), dtype=np.uint8).reshape(-1, _BITS // 8)
        runs = np.zeros((len(five), 8), dtype=np.uint8)
        runs[:, : _BITS // 8] = five
        owners, sizes = (pc.list_flatten(part.column(c)).to_numpy() for c in ("owners", "sizes"))
        # Copies of a record come from several batches; those after the first are dropped.
        once = np.zeros(len(owners), dtype=bool)
        once[np.unique(owners, return_index=True)[1]] = True
        kept = np.repeat(once, sizes)
        sides[e] = runs.view(np.int64).reshape(-1)[kept], np.repeat(owners, sizes)[kept]
    (asked, asker), (held, holder) = sides[True], sides[False]
    wanted = np.isin(held, asked)
    order = np.argsort(held[wanted], kind="stable")
    held, holder = held[wanted][order], holder[wanted][order]
    kinds, counts = np.unique(held, return_counts=True)
    at = np.searchsorted(kinds, asked)
    hit = at < len(kinds)
    hit[hit] = kinds[at[hit]] == asked[hit]
    askers, who = np.unique(asker, return_inverse=True)
    at, of = at[hit], who[hit]
    at = at[np.argsort(of, kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(askers))))
    records = [askers, [None] * len(askers), np.bincount(who, minlength=len(askers)), ends, kinds[at] + high, counts[at]]
    starts = np.cumsum(counts) - counts
    rows = -(-counts // _HOLDERS)  # a common run's holders are in several rows
    nth = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    holders = [[None] * len(nth), np.repeat(kinds, rows) + high, np.zeros(len(nth)), np.append(np.repeat(starts, rows) + nth * _HOLDERS, len(holder)), holder, np.zeros(len(holder))]
    made = []
    for owner, run, n, ends, *values in (records, holders):
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(t))) for v, t in zip(values, (np.int64, np.int32))]
        made.append(pa.table([pa.array(owner, pa.int64()), pa.array(run, pa.int64()), pa.array(n.astype(np.int32)), *lists], names=["owner", "run", "n", "found", "held_by"]))
    return pa.concat_tables(made)


@lru_cache(maxsize=1024)
def _parts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of a text, its chunks' digests and their lengths; kept for the next pair, as a text is often in several. No runs under 20 words."""
    tokens = words(text)
    runs = np.unique(runs_of(hashed(tokens))) if len(tokens) >= LEAST_WORDS else np.zeros(0, dtype=np.uint64)
    return (runs, *chunks(tokens))


def _linked(df: DataFrame, share: float, key: str, text: str, split: str) -> tuple[DataFrame, DataFrame]:
    """members (id, eval, rep): every record with the least key that has the same words on its side; links (a, b, runs_shared, chunks_shared) of these."""
    rows = df.select(F.col(key).cast("long").alias("id"), split_name(split).alias("split"), F.col(text).alias("text"))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL AND split IN ('train', 'validation', 'test')").select("id", (F.col("split") != "train").alias("eval"), "text")
    members = staged(batched(rows, "id long, eval boolean, same long, n_words int", _named), "records")
    runs = members.agg(F.sum("n_words")).first()[0] or 0
    # Records of the same words on the same side are looked up once, by the least key among them.
    side = members.select("id", "eval", "same").distinct()
    rep = side.groupBy("eval", "same").agg(F.min("id").alias("rep"))
    members = side.join(rep, ["eval", "same"]).select("id", "eval", "rep")
    # Buckets grow in number with the data, so that one task holds some BUCKET_RUNS runs at most.
    buckets = max(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs // BUCKET_RUNS))
    packed = batched(rows.select("eval", "text"), "bucket int, eval boolean, owners array<long>, sizes array<int>, runs binary", _packed(buckets))
    met = staged(packed.groupBy("bucket").applyInArrow(_met, "owner long, run long, n int, found array<long>, held_by array<int>"), "met")

    def asked(a: int, n: int, found: list[int], held_by: list[int]) -> Iterator[tuple]:
        need = max(1, math.ceil(share * n - 1e-9))
        more = (need - 1) // _MORE
        for _, run in sorted(zip(held_by, found))[: len(found) - need + 1 + more] if len(found) >= need else ():
            yield a, run, 1 + more

    seen = met.where("owner IS NOT NULL").groupBy("owner").agg(F.sum("n").cast("int").alias("n"), F.flatten(F.collect_list("found")).alias("found"), F.flatten(F.collect_list("held_by")).alias("held_by"))
    looked_up = each(seen.select("owner", "n", "found", "held_by"), "same long, run long, least int", asked)
    left, right = rep.where("eval").select("same", F.col("rep").alias("a")), rep.where("NOT eval").select(F.col("same").alias("holder"), F.col("rep").alias("b"))
    holders = met.where("run IS NOT NULL").select("run", F.col("found").alias("holders"))
    shared = looked_up.join(holders, "run").select("same", "least", F.explode("holders").alias("holder"))
    shared = shared.groupBy("same", "least", "holder").agg(F.count("*").alias("n")).where("n >= least").select("same", "holder")
    pairs = staged(shared.join(left, "same").join(right, "holder").select("a", "b").distinct(), "pairs")
    kept = only_keys(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    with_a = pairs.join(kept.where("eval").select(F.col("id").alias("a"), F.col("text").alias("one")), "a")
    with_b = with_a.join(kept.where("NOT eval").select(F.col("id").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "one", "other")

    def measured(a: int, b: int, one: str, other: str) -> Iterator[tuple]:
        (p, c, n), (q, d, _) = _parts(one), _parts(other)
        both = common(p, q)
        if both and both >= share * len(p) - 1e-9:
            yield a, b, both / len(p), float(n[np.isin(c, d)].sum() / max(1, n.sum()))

    return members, each(with_b, "a long, b long, runs_shared double, chunks_shared double", measured)


def overlaps(df: DataFrame, share: float = SHARE, key: str = "pos", text: str = "text", split: str = "split") -> DataFrame:
    """(eval_pos, train_pos, runs_shared, chunks_shared): pairs of which at least ``share`` of the evaluation text's runs stand in the training text.

    ``runs_shared`` and ``chunks_shared`` are the shares of the evaluation text's distinct runs, and of the words of its distinct chunks, that stand
    in the training text. Rows with a NULL key or text, under 20 words, or in no known split take no part. Repeated rows
    count once; a key that comes with several texts or splits counts with each, never against itself, and what is found for
    one of its texts counts for it and for all records with a copy of any of them.
    """
    members, links = _linked(df, share, key, text, split)
    left = members.where("eval").select(F.col("rep").alias("a"), F.col("id").alias("eval_pos"))
    right = members.where("NOT eval").select(F.col("rep").alias("b"), F.col("id").alias("train_pos"))
    pairs = links.join(left, "a").join(right, "b").where("eval_pos <> train_pos")
    return pairs.groupBy("eval_pos", "train_pos").agg(F.max("runs_shared").alias("runs_shared"), F.max("chunks_shared").alias("chunks_shared"))


def pair_counts(df: DataFrame, share: float = SHARE, key: str = "pos", text: str = "text", split: str = "split") -> DataFrame:
    """(eval_pos, pairs): how many pairs of ``overlaps`` each evaluation record with any is in. Copies of a training record are counted, never listed."""
    members, links = _linked(df, share, key, text, split)
    train = members.where("NOT eval").select("id", F.col("rep").alias("b"))
    several = train.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1")
    # A key with one training text is in one class; only those with several can be met twice by a record, so they alone are listed.
    single = train.join(several, "id", "left_anti")
    own = members.where("eval").select(F.col("rep").alias("a"), F.col("id").alias("eval_pos"))
    met = staged(links.select("a", "b").join(own, "a").select("eval_pos", "b").distinct(), "met_classes")
    counted = met.join(single.groupBy("b").agg(F.count("*").alias("n")), "b").select("eval_pos", "n")
    itself = met.join(single.withColumnRenamed("id", "eval_pos"), ["eval_pos", "b"]).select("eval_pos", F.lit(-1).cast("long").alias("n"))
    listed = met.join(train.join(several, "id").select("id", "b"), "b").where("id <> eval_pos").select("eval_pos", "id").distinct().select("eval_pos", F.lit(1).cast("long").alias("n"))
    return counted.unionByName(itself).unionByName(listed).groupBy("eval_pos").agg(F.sum("n").alias("pairs")).where("pairs > 0")


def per_split_and_source(df: DataFrame, found: DataFrame, key: str = "pos", split: str = "split", source: str = "source") -> DataFrame:
    """(split, source, records, overlapping, pairs): of every evaluation split and source, the records, those found in training, and the pairs.

    ``found`` are the rows of ``overlaps`` or of ``pair_counts``.
    """
    rows = df.select(F.col(key).cast("long").alias("eval_pos"), split_name(split).alias("split"), F.col(source).alias("source")).where("split IN ('validation', 'test')").distinct()
    per = found if "pairs" in found.columns else found.groupBy("eval_pos").agg(F.count("*").alias("pairs"))
    joined = rows.join(per, "eval_pos", "left")
    return joined.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
