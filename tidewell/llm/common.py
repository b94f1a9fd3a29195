"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; numpy keeps a few 8-byte values for each.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_shipped: set[str] = set()


#: Bytes of an Arrow batch between the JVM and Python, where the session keeps Spark's default of 64 MB:
#: a text column's batch stands in memory four times, in either process as it is made and as it is read.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors, once for each application, and keep Arrow batches small."""
    if spark.conf.get(_BATCH_KEY).removesuffix("b") == str(64 << 20):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="tidewell-code-")) / "tidewell_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none (tests, a laptop) a local folder is made
    and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tidewell-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dotted(column: str):
    """A column by its own name, dots and all."""
    return F.col(f"`{column.replace('`', '``')}`")


def text_id(column: str):
    """128 bits of a digest that no two texts are known to share; null is empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(dotted(column).cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


class Table:
    """Rows gathered by several writes."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def add(self, df: DataFrame) -> None:
        self.n += 1
        df.write.option("compression", "zstd").parquet(f"{self.path}/part={self.n}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/part={k + 1}" for k in range(self.n)])


class Workspace:
    """Intermediate tables of one call in a folder of their own, removed as soon as its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path, self.n = spark, name, scratch(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: cuts lineage, survives lost executors."""
        self.n += 1
        path = f"{self.path}/{self.n:03}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, name: str, schema: str) -> Table:
        """A table of this folder that rows are added to."""
        self.n += 1
        return Table(self.spark, f"{self.path}/{self.n:03}-{name}", schema)

    def result(self, df: DataFrame) -> DataFrame:
        """df written beside the folder, which then goes."""
        out = materialise(df, f"{self.name}-result")
        self.remove(self.path)
        return out

    def remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str:
    """The path that Python opens for a file: URI; other schemes are left to pyarrow."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) for a shared-folder URI or path."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), local_path(uri)
    return pafs.FileSystem.from_uri(uri)


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(dotted(column).cast("string"), F.lit("")).cast("binary"))


def is_held_out(column: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.pmod(crc32_of_id(column), F.lit(4)) == 2


def utf8(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each row) of a string or binary column; null is empty.

    Views of the Arrow buffers where the column has no nulls.
    """
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of about `most` bytes of text; a longer row is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch, column)
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(at, at[row] + most, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def concat_rows(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to about `most` bytes of a column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and any(x.num_rows for x in held):
        yield pa.Table.from_batches([x for x in held if x.num_rows]).combine_chunks().to_batches()[0]
