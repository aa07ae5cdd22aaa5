"""Checks of words, languages and characters against lists and rules.

A dictionary is a table of words, of any size: it is counted, sent to every executor up to a bound and joined by shuffle beyond. Words
of texts are parted from their rows for the lookup, and only what isn't known travels on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import text as X
from tapeloom.plans import filtering


def dictionary(df: DataFrame) -> DataFrame:
    """(w): the distinct lower-case words of a dictionary table (word), without NULL."""
    return df.where("word IS NOT NULL").select(F.lower("word").alias("w")).distinct()


def _unknown(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """The rows whose ``w`` isn't in the dictionary."""
    return tokens.join(filtering.sent(words), "w", "left_anti")


def all_words_known(df: DataFrame, words: DataFrame) -> DataFrame:
    """(pos, known): whether all blank-separated words are in the dictionary; true for a text without words."""
    flat = df.select("pos", F.explode(F.array_distinct(X.blank_separated(F.lower("text")))).alias("w"))
    odd = _unknown(flat, words).select("pos", F.lit(True).alias("odd")).distinct()
    return df.select("pos").join(odd, "pos", "left").select("pos", F.col("odd").isNull().alias("known"))


def unknown_rows(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(pos, line_no, n_unknown): lines with alphabetic tokens that aren't in the dictionary."""
    flat = lines.select("pos", "line_no", F.explode(F.filter(X.tokens(F.lower("line")), X.is_alphabetic)).alias("w"))
    return _unknown(flat, words).groupBy("pos", "line_no").agg(F.count("*").alias("n_unknown"))


def unknown_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(pos, line_number, words): of indented lines, from 1, the words without punctuation that aren't in the dictionary, in order.

    A word of punctuation only becomes the empty string, which is unknown unless the dictionary holds it.
    """
    bare = F.transform(X.blank_separated("line"), lambda w: F.lower(X.without_punctuation(w)))
    flat = lines.where(F.col("line").startswith(" ")).select("pos", (F.col("line_no") + 1).alias("line_number"), F.posexplode(bare).alias("place", "w"))
    odd = _unknown(flat, words).groupBy("pos", "line_number").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("s"))
    return odd.select("pos", "line_number", F.array_join(F.transform("s", lambda x: x["w"]), " ").alias("words"))


def not_english(df: DataFrame) -> DataFrame:
    """(pos, lang): texts labelled in another language, or not labelled."""
    return df.select("pos", F.coalesce("lang", F.lit("undetected")).alias("lang")).where("lang <> 'en'")
