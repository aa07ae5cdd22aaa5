"""Running sums and row numbers over a whole table without one task that holds it all.

A window without PARTITION BY sends every row to one task. Here the rows are spread over ordered buckets, the bucket
totals (one row a bucket, a bounded number) are summed by a window, and only then a window runs inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_sum(df: DataFrame, bucket: str, order: list[Column], value: str, into: str, within: list[str] | None = None) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over all earlier rows and this one, by (bucket, order), restarted for each ``within``.

    ``bucket`` must grow with the order and split the rows evenly; ``order`` must be total inside a bucket.
    NULL values count as 0. The bucket totals are one row for each bucket, joined back by bucket.
    """
    keys = [*(within or []), bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = before.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = None
    for k in keys:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = c if same is None else same & c
    joined = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("l").join(totals.alias("r"), same)
    return joined.select("l.*", (F.col("r._before") + F.col("l._inside")).alias(into)).drop("_inside")


#: Rows of consecutive keys in a bucket.
BUCKET_KEYS = 10_000


def numbered(df: DataFrame, key: str, order: list[str], into: str = "idx") -> DataFrame:
    """Adds the place, from 0, of each row by ``order``, whose first column is the whole number ``key``; NULL keys come first.

    Buckets are stretches of keys, so keys should be dense, as positions are.
    """
    rows = df.withColumn("_bucket", F.coalesce(F.floor(F.col(key) / BUCKET_KEYS), F.lit(-(1 << 62)))).withColumn("_one", F.lit(1).cast("long"))
    summed = running_sum(rows, "_bucket", [F.asc_nulls_first(c) for c in order], "_one", "_n")
    return summed.withColumn(into, F.col("_n") - 1).drop("_bucket", "_one", "_n")
