"""Lines, blocks and manifests of the tables. Every row keeps its key and its place, as DataFrames have no order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import text as X
from tapeloom.plans.prefix import numbered, running_sum


def transcripts(df: DataFrame) -> DataFrame:
    """Transcripts with text, once each: a row delivered twice counts once."""
    return df.where("pos IS NOT NULL AND text IS NOT NULL").select("pos", "text", "lang", "source").distinct()


def lines(df: DataFrame) -> DataFrame:
    """(pos, line_no, line): the lines of every text from 0, a trailing empty one included."""
    return df.select("pos", F.posexplode(X.lines("text")).alias("n", "line")).select("pos", F.col("n").cast("long").alias("line_no"), "line")


def corpus_starts(df: DataFrame) -> DataFrame:
    """(pos, start_line, n_lines): where each text stands in the one file that holds all, two blank lines after each.

    The file itself is never built: line counts are summed in order of ``pos``.
    """
    counted = df.select("pos", F.size(X.lines("text")).cast("long").alias("n_lines")).withColumn("_step", F.col("n_lines") + 2)
    rows = counted.withColumn("_bucket", F.floor(F.col("pos") / 10_000))
    summed = running_sum(rows, "_bucket", [F.asc("pos")], "_step", "_sum")
    return summed.select("pos", (F.col("_sum") - F.col("_step")).alias("start_line"), "n_lines")


def manifest(df: DataFrame) -> DataFrame:
    """(pos, path, size_bytes): manifest rows with a path, once each."""
    return df.where("pos IS NOT NULL AND mp3_file_list <> ''").select("pos", F.col("mp3_file_list").alias("path"), "size_bytes").distinct()


def with_index(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return numbered(df, key, order)
