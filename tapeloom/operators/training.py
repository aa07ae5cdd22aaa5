"""Preparing samples: encoding, splitting and batching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import text as X
from tapeloom.functions import vectors as V
from tapeloom.operators import profile, scan
from tapeloom.plans import filtering
from tapeloom.plans.prefix import numbered, running_sum
from tapeloom.plans.stage import staged

#: Ids: padding, unknown words, and the dictionary's words from FIRST_WORD on.
LENGTH, PAD, UNKNOWN, FIRST_WORD = 768, 0, 1, 2
IGNORED = -100


def _listed(words: DataFrame) -> list[str] | None:
    """The words (w) in order, if they are few enough to be sent to every task; else None."""
    return sorted(r.w for r in words.collect()) if filtering.is_small(words) else None


def numbered_words(words: DataFrame) -> DataFrame:
    """(w, id): each dictionary word's place in order plus FIRST_WORD, whatever the size of the dictionary."""
    return profile.ranked(words, ["w"], "place").select("w", (F.col("place") + FIRST_WORD).cast("int").alias("id"))


def ids(df: DataFrame, words: DataFrame, length: int | None = None) -> DataFrame:
    """(pos, ids): the ids of each text's lower-case tokens, of the first ``length`` if that is given: a dictionary word's place plus 2, 1 for all others.

    A small dictionary goes to the texts, so that these aren't shuffled; a large one is joined with the tokens by word, and the tokens are put
    together again by text. Texts of NULL have no row.
    """
    tokens = X.tokens(F.lower("text"))
    rows = df.where("text IS NOT NULL").select(F.col("pos").cast("long").alias("pos"), F.slice(tokens, 1, length).alias("t") if length else tokens.alias("t"))
    listed = _listed(words)
    if listed is None:
        return _joined_ids(rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(listed, pa.string())
        for b in batches:
            lists = b.column(1)
            found = pc.fill_null(pc.add(pc.index_in(lists.flatten().cast(pa.string()), known), FIRST_WORD), UNKNOWN).cast(pa.int32())
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array([0, *lengths.cumsum().tolist()], pa.int32()), found)], names=["pos", "ids"])

    return rows.mapInArrow(run, "pos long, ids array<int>")


def _joined_ids(rows: DataFrame, words: DataFrame) -> DataFrame:
    # A key with several texts keeps them apart by their tokens' digest; copies of a row are one.
    keyed = rows.withColumn("same", F.md5(F.array_join("t", " "))).dropDuplicates(["pos", "same"])
    flat = keyed.select("pos", "same", F.posexplode_outer("t").alias("place", "w"))
    found = flat.join(numbered_words(words).hint("merge"), "w", "left").select("pos", "same", F.struct("place", F.coalesce("id", F.lit(UNKNOWN)).alias("id")).alias("x"))
    put = found.groupBy("pos", "same").agg(F.array_sort(F.collect_list(F.when(F.col("x.place").isNotNull(), F.col("x")))).alias("s"))
    return put.select("pos", F.transform("s", lambda x: x["id"]).alias("ids"))


def encoded(df: DataFrame, words: DataFrame, length: int = LENGTH) -> DataFrame:
    """(pos, input_ids, attention_mask, labels, padded_labels): fixed-length samples.

    ``labels`` have the padding ignored; ``padded_labels`` are the ids as they are, padding included.
    """
    made = ids(df, words, length)
    made = made.select("pos", V.padded(F.col("ids"), length, PAD).alias("input_ids"), V.attention(F.col("ids"), length).alias("attention_mask"))
    return made.withColumn("labels", V.labels(F.col("input_ids"), PAD, IGNORED)).withColumn("padded_labels", F.col("input_ids"))


def decoded(df: DataFrame, words: DataFrame, column: str = "input_ids") -> DataFrame:
    """(pos, text): ids back to words, the padding and unknown ones skipped."""
    rows = df.select(F.col("pos").cast("long").alias("pos"), F.filter(column, lambda i: i >= FIRST_WORD).alias("i"))
    listed = _listed(words)
    if listed is None:
        keyed = rows.withColumn("same", F.md5(F.array_join(F.col("i").cast("array<string>"), " "))).dropDuplicates(["pos", "same"])
        flat = keyed.select("pos", "same", F.posexplode_outer("i").alias("place", "id")).join(numbered_words(words).hint("merge"), "id", "left")
        put = flat.groupBy("pos", "same").agg(F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("place", "w")))).alias("s"))
        return put.select("pos", F.array_join(F.transform("s", lambda x: x["w"]), " ").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(listed, pa.string())
        for b in batches:
            lists = b.column(1)
            at = pc.subtract(lists.flatten(), FIRST_WORD)
            said = names.take(pc.if_else(pc.less(at, len(names)), at, None))
            ends = pa.array([0, *pc.list_value_length(lists).to_numpy(zero_copy_only=False).cumsum().tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_join(pa.ListArray.from_arrays(ends, said), " ")], names=["pos", "text"])

    return rows.mapInArrow(run, "pos long, text string")


def gpt2_encoded(df: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """(pos, n_ids, input_ids, attention_mask): the same with GPT-2's byte pairs and its end of text (50256) for padding."""
    from tapeloom.sources.tokenizers import gpt2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = gpt2(folder)
        for b in batches:
            found = [encoding.encode_ordinary(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["pos", "ids"])

    made = df.select("pos", "text").mapInArrow(run, "pos long, ids array<int>")
    end = 50_256
    return made.select("pos", F.size("ids").cast("long").alias("n_ids"), V.padded(F.col("ids"), length, end).alias("input_ids"), V.attention(F.col("ids"), length).alias("attention_mask"))


def _drawn(part: int, *of) -> Column:
    """A whole number below 2^32 that depends on ``of`` alone, the same in any engine: eight of the digits of an MD5 digest, from digit 8 x ``part`` on."""
    digest = F.md5(F.concat_ws("|", *(F.lit(x).cast("string") if isinstance(x, int) else x.cast("string") for x in of)))
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("long")


def masked(df: DataFrame, words: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """(pos, input_ids, labels): samples for masked training. Of all places ``share`` are hidden; which ones depends on key, place and seed alone.

    Of the hidden ids eight in ten become the mask (the first id after the dictionary's), one any word's id, and one stays; ``labels`` are the ids of hidden places,
    IGNORED elsewhere. Texts without tokens have no row.
    """
    n = words.count()
    mask = FIRST_WORD + n

    def place(x, i):
        drawn = lambda part: _drawn(part, seed, F.col("pos"), i)
        hidden, kind = drawn(0) % 10_000 < int(share * 10_000), drawn(1) % 10
        other = (drawn(2) % max(1, n) + FIRST_WORD).cast("int") if n else F.lit(UNKNOWN)
        new = F.when(~hidden, x).when(kind < 8, F.lit(mask)).when(kind == 8, other).otherwise(x)
        return F.struct(new.alias("id"), F.when(hidden, x).otherwise(F.lit(IGNORED)).alias("label"))

    made = ids(df, words).where(F.size("ids") > 0).select("pos", F.transform("ids", place).alias("s"))
    return made.select("pos", F.transform("s", lambda x: x["id"]).alias("input_ids"), F.transform("s", lambda x: x["label"]).alias("labels"))


def split_in_order(indexed: DataFrame, cuts: list[tuple[str, float]], last: str, n: int, idx: str = "idx") -> DataFrame:
    """Adds ``split``: rows below each cut, a share of all ``n`` rows as a Python float truncated to a whole number, in turn."""
    said = None
    for name, share in cuts:
        below = F.col(idx) < int(n * share)
        said = F.when(below, name) if said is None else said.when(below, name)
    return indexed.withColumn("split", said.otherwise(last))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``idx``: the row's place in an order by the MD5 digest of seed and key, the same on every run and in every engine."""
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    # Buckets are stretches of digests in order: their first three digits.
    rows = rows.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")).withColumn("_one", F.lit(1).cast("long"))
    summed = running_sum(rows, "_b", [F.asc("_h"), F.asc(key)], "_one", "_n")
    return summed.withColumn("idx", F.col("_n") - 1).drop("_h", "_b", "_one", "_n")


def training_set(df: DataFrame, most_tokens: int = LENGTH, share: float = 0.8) -> DataFrame:
    """(pos, line_no, n_tokens, split): non-empty lines, the first of each kept, under the token limit, split in order.

    Lines are grouped by digest and length, so that no line is a key of a shuffle; what is kept is written once, as it is counted and then numbered.
    """
    rows = scan.lines(df).where("line <> ''").select(F.md5("line").alias("d"), F.length("line").alias("n"), "pos", "line_no", X.n_tokens("line").alias("n_tokens"))
    first = rows.groupBy("d", "n").agg(F.min(F.struct("pos", "line_no", "n_tokens")).alias("k"))
    kept = staged(first.select("k.*").where(F.col("n_tokens") < most_tokens), "kept")
    indexed = numbered(kept, "pos", ["pos", "line_no"])
    return split_in_order(indexed, [("train", share)], "validation", kept.count()).drop("idx")
