"""Keeping the rows whose key is in another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key table of at most this many rows (8 bytes each and the hash table round them) is sent to every executor.
MOST_SENT = 200_000


def is_small(df: DataFrame) -> bool:
    """Whether a table has at most MOST_SENT rows, which is counted."""
    return df.limit(MOST_SENT + 1).count() <= MOST_SENT


def sent(df: DataFrame) -> DataFrame:
    """A lookup table for a join: broadcast if it has at most MOST_SENT rows, else to be shuffled by key with the other side."""
    return F.broadcast(df) if is_small(df) else df.hint("merge")


def only_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose ``on`` is in ``keys``, a cheap table of distinct BIGINT keys in a column of that name.

    The keys are counted first. Up to MOST_SENT they are broadcast, so that ``df``, wide as it may be, isn't shuffled;
    beyond that both sides are shuffled by key.
    """
    return df.join(sent(keys), on, "left_semi")
