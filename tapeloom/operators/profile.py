"""Counts, distributions and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.prefix import running_sum

WIDTH = 10


def stats(df: DataFrame, x: str) -> DataFrame:
    """(n, least, most, mean, total) of a whole-number column; NULL values are passed over."""
    return df.agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.sum(x).cast("long").alias("total"))


def most_quirk(df: DataFrame, key: str, x: str) -> DataFrame:
    """(most): the maximum over the values that set no new strict minimum in order of ``key``, 0 if all do.

    The running minimum over buckets of keys needs one row a bucket; only then the rows of each bucket are gone through.
    """
    from pyspark.sql.window import Window

    rows = df.where(F.col(x).isNotNull()).select(key, x).withColumn("_b", F.floor(F.col(key) / 10_000))
    before = rows.groupBy("_b").agg(F.min(x).alias("_m")).withColumn("_m", F.min("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.min(x).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    seen = rows.withColumn("_i", inside).join(before, "_b").withColumn("_least", F.least("_i", "_m"))
    return seen.agg(F.coalesce(F.max(F.when(F.col(x) >= F.col("_least"), F.col(x))), F.lit(0)).alias("most"))


def distribution(df: DataFrame, x: str) -> DataFrame:
    """(x, n): how often each value comes."""
    return df.groupBy(x).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, x: str, width: int = WIDTH) -> DataFrame:
    """(bin, label, n): half-open bins from the least value on, empty ones too; a maximum on a bin's edge has no bin."""
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    bins = -(-(hi - lo) // width) if lo is not None else 0
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    start = 0 if lo is None else lo
    counted = df.where(F.col(x).isNotNull()).groupBy(F.floor((F.col(x) - start) / width).alias("bin")).agg(F.count("*").alias("n"))
    label = F.floor((F.col("bin") * (2 * width) + (2 * start + width)) / 2)
    return every.join(counted, "bin", "left").select("bin", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def batch_means(df: DataFrame, idx: str, x: str, size: int) -> DataFrame:
    """(mean): the mean of the means of consecutive batches; a short last batch has full weight."""
    return df.groupBy(F.floor(F.col(idx) / size).alias("b")).agg(F.avg(x).alias("m")).agg(F.avg("m").alias("mean"))


def ranked(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Adds the place, from 0, of each row in the order of ``order``, which must be total.

    Rows are spread by range; the ranges, which a new sampling could draw otherwise, are written down before they are counted.
    """
    from tapeloom.plans.stage import staged

    spread = staged(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()).withColumn("_one", F.lit(1).cast("long")), "ranges")
    summed = running_sum(spread, "_bucket", [F.asc(c) for c in order], "_one", "_n")
    return summed.withColumn(into, F.col("_n") - 1).drop("_bucket", "_one", "_n")
