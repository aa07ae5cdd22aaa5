"""Text files in, text files out. Reading never guesses a schema; writing never gathers a corpus in one task."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tapeloom.functions import text as X


def corpora(spark: SparkSession, path: str) -> DataFrame:
    r"""(path, blob): one row a file, whole, with ``\n`` line ends."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), X.unix_lines("value").alias("blob"))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): the lines of each file from 0, a trailing empty one included."""
    cut = corpora(spark, path).select("path", F.posexplode(X.lines("blob")).alias("n", "line"))
    return cut.select("path", F.col("n").cast("long").alias("line_no"), "line")


def document_map(spark: SparkSession, folder: str, ending: str = ".txt") -> DataFrame:
    """(path, blob): the files of a folder, not of those below, that end so."""
    rows = spark.read.option("pathGlobFilter", f"*{ending}").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), X.unix_lines("value").alias("blob"))


def found(spark: SparkSession, folder: str, ending: str = ".mp3") -> DataFrame:
    """(path, size_bytes, modified_at): all files below a folder that end so; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(folder)
    return rows.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def write_corpus(blocks: DataFrame, path: str, order: str = "pos", text: str = "text", mode: str = "errorifexists") -> None:
    r"""The texts in order, each followed by ``\n\n\n``, as files whose names sort in that order; ``mode`` append adds to a corpus."""
    rows = blocks.where(F.col(text).isNotNull()).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    rows.select(F.concat(X.unix_lines(text), F.lit("\n\n")).alias("value")).write.mode(mode).text(path)  # the writer ends each row with the third


def write_blocks(blocks: DataFrame, folder: str, name: str = "name", text: str = "text", order: str = "pos") -> None:
    """A folder for each name, with the lines of its last block that aren't blank; of one name's blocks the last by ``order`` wins."""
    last = blocks.where(F.col(name).isNotNull() & F.col(text).isNotNull()).groupBy(name).agg(F.max_by(text, order).alias("value"))
    kept = F.filter(X.lines("value"), lambda line: F.trim(line) != "")
    last.select(F.col(name).alias("name"), F.array_join(kept, "\n").alias("value")).write.partitionBy("name").mode("overwrite").text(folder)


def _place(folder: str):
    """The file system that holds ``folder``, and the folder's path in it; every executor has to reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.rstrip("/"))


def write_named(blocks: DataFrame, folder: str, name: str = "name", text: str = "text", order: str = "pos", ending: str = ".txt", keep: str = "last") -> None:
    """One file a name, under the very name it gives, folders in it included; an older file of the name is replaced.

    Of several blocks of a name the last by ``order`` is written without its blank lines, or, with ``keep`` all, every block in order. Rows with a NULL
    name or text are left out; a name that leads out of ``folder`` fails the job. A file appears whole or not at all, so a task may run twice.
    """
    rows = blocks.where(F.col(name).isNotNull() & F.col(text).isNotNull()).select(F.col(name).alias("name"), F.col(text).alias("text"), F.col(order).alias("at"))
    if keep == "last":
        one = rows.groupBy("name").agg(F.max_by("text", "at").alias("text"))
        one = one.select("name", F.array_join(F.filter(X.lines("text"), lambda line: F.trim(line) != ""), "\n").alias("text"))
    else:
        one = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("s")).select("name", F.array_join(F.transform("s", lambda x: X.unix_lines(x["text"])), "\n").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(folder)
        for b in batches:
            for said, value in zip(*(c.to_pylist() for c in b.columns)):
                path = posixpath.normpath(posixpath.join(root, said + ending))
                if not path.startswith(posixpath.normpath(root) + "/"):
                    raise ValueError(f"{said!r} leads out of the folder")
                system.create_dir(posixpath.dirname(path), recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write((value + "\n").encode())
                system.move(part, path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    one.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def existing(df: DataFrame, path: str, folder: str = "") -> DataFrame:
    """The rows with ``exists``: whether there is a file or folder at ``path``, which may be relative to ``folder``; false for NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            found = []
            for p in b.column(b.schema.get_field_index(path)).to_pylist():
                system, at = _place(posixpath.join(folder, p)) if p else (None, "")
                found.append(bool(at) and system.get_file_info(at).type != fs.FileType.NotFound)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, "exists"])

    kept = df.drop("exists")
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("exists", BooleanType())]))


def write_index(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Index rows ``n) line - name`` of (n, start_line, path), in order of ``n``; rows with a NULL are left out."""
    rows = blocks.where("n IS NOT NULL AND start_line IS NOT NULL AND path IS NOT NULL").repartitionByRange("n").sortWithinPartitions("n")
    rows.select(X.index_row(F.col("n"), F.col("start_line"), F.col("path")).alias("value")).write.mode(mode).text(path)


def write_manifest(files: DataFrame, path: str, column: str = "path", mode: str = "errorifexists") -> None:
    """The paths of a manifest in order, one a line."""
    rows = files.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    rows.repartitionByRange("value").sortWithinPartitions("value").write.mode(mode).text(path)


def table_of_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header as the columns of ``schema``, which is given, as nothing is guessed; quoted values may hold line ends."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def without(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in ``removed``: inputs are never deleted, survivors are written anew."""
    return df.join(removed.select(key).distinct(), key, "left_anti")
