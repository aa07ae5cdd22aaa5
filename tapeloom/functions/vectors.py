"""Column expressions on arrays of numbers and on maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(vector: str) -> Column:
    """The place, from 0, of the first greatest value; NULL for NULL and empty arrays."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("long")


def padded(ids: Column, length: int, pad: int) -> Column:
    """Cut or filled up to exactly ``length``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention(ids: Column, length: int) -> Column:
    """1 for each place that holds an id, 0 for each filled up."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= F.size(ids), 1).otherwise(0))


def labels(ids: Column, pad: int, ignored: int = -100) -> Column:
    """The ids with the padding made the ignored index; genuine ids equal to it go the same way."""
    return F.transform(ids, lambda x: F.when(x == pad, ignored).otherwise(x))


def looked_up(key: str, values: dict[int, str], default: str) -> Column:
    """A map's value, or the default."""
    made = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(made, F.col(key)), F.lit(default))
