"""Running a Python function over Arrow batches, and one row a key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def batched(df: DataFrame, schema: str, make: Callable[..., list[list]]) -> DataFrame:
    """``make`` gets a batch's columns as lists and returns the result's columns as lists in the order of ``schema``."""
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(make(*(c.to_pylist() for c in b.columns)), target)], schema=target)

    return df.mapInArrow(run, schema)


def each(df: DataFrame, schema: str, make: Callable[..., Iterable[tuple]], rows: int = 8192) -> DataFrame:
    """``make`` gets a row's values and yields result rows as tuples in the order of ``schema``. Results leave in batches of about ``rows``."""
    target = to_arrow_schema(_parse_datatype_string(schema))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns)):
                found.extend(make(*values))
                if len(found) >= rows:
                    yield batch(found)
                    found = []
        if found:
            yield batch(found)

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: str, most: int) -> list:
    """At most ``most`` rows of ``df``, collected: those with the least hash of ``key``, the same whatever the order of the rows.

    Rows are counted first and thinned by hash before they are sorted, so that tasks don't each send ``most`` rows to the driver.
    """
    thinned = df
    if (n := df.count()) > 2 * most:
        thinned = df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < F.lit(max(1, 2_000_000 * most // n)))
    return thinned.orderBy(F.xxhash64(key), key).limit(most).collect()
