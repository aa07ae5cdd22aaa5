"""The line scan and the run log as streams: the same operators, fed by files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import scan


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, line_no, line) of transcripts (pos BIGINT, text STRING) that arrive as parquet files in a folder."""
    rows = spark.readStream.schema("pos long, text string").parquet(folder)
    return scan.lines(rows.where("pos IS NOT NULL AND text IS NOT NULL"))


def arriving_losses(spark: SparkSession, folder: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, run_id, epochs, least_loss) by window of log rows (run_id, epoch, valid_loss, at) as they arrive, late ones up to ``late``."""
    rows = spark.readStream.schema("run_id long, epoch int, valid_loss double, at timestamp").parquet(folder).withWatermark("at", late)
    found = rows.groupBy(F.window("at", window).alias("w"), "run_id").agg(F.count("epoch").alias("epochs"), F.min("valid_loss").alias("least_loss"))
    return found.select(F.col("w.start").alias("start"), "run_id", "epochs", "least_loss")
