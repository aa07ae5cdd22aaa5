"""Where work that Spark has no operator for is plugged in: detectors, transcribers, objectives. The callables run on the executors, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDETECTED = "undetected"


def detected(df: DataFrame, detect: Callable[[str], str], key: str = "pos", text: str = "text") -> DataFrame:
    """(key, lang): what ``detect`` says of each text; ``undetected`` where it raises or says nothing, and for NULL texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                try:
                    found.append((detect(t) if t is not None else None) or UNDETECTED)
                except Exception:  # a detector may fail in any way on odd text
                    found.append(UNDETECTED)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=[key, "lang"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, lang string")


def transcribed(files: DataFrame, make: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """(path, text) of binary files (path, content). ``make`` builds the transcriber, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transcribe = make()
        for b in batches:
            yield pa.RecordBatch.from_pydict({"path": b.column(0), "text": pa.array([None if c is None else transcribe(c) for c in b.column(1).to_pylist()], pa.string())})

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def tried(grid: DataFrame, objective: Callable[[float, int], float]) -> DataFrame:
    """``grid`` (trial_id, learning_rate, batch_size) with ``val_loss``: what the objective gives for each trial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rates, sizes = (c.to_pylist() for c in b.columns)
            losses = [float(objective(r, s)) for r, s in zip(rates, sizes)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(losses, pa.float64())], names=["trial_id", "learning_rate", "batch_size", "val_loss"])

    rows = grid.select(F.col("trial_id").cast("int").alias("trial_id"), F.col("learning_rate").cast("double").alias("learning_rate"), F.col("batch_size").cast("int").alias("batch_size"))
    return rows.mapInArrow(run, "trial_id int, learning_rate double, batch_size int, val_loss double")


def parameter_counts(params: DataFrame) -> DataFrame:
    """(tensors, elements) of a listing (name STRING, shape ARRAY<INT>); a shape without dimensions holds one element."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return params.agg(F.count("name").alias("tensors"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("elements"))
