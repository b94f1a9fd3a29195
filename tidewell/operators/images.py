"""Pictures as files: PNG encoding in tasks, and a folder of frames that appears whole or not at all."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def png(picture: np.ndarray) -> bytes:
    """Eight-bit RGB or grey without loss; each row is stored as differences to the row above."""
    grey = picture.ndim == 2
    rows = picture.reshape(len(picture), -1).astype(np.uint8)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0] = 2  # fixed value: the filter `up`
    lines[:, 1:] = rows - np.concatenate([np.zeros_like(rows[:1]), rows[:-1]])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", picture.shape[1], picture.shape[0], 8, 0 if grey else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def write_frames(df: DataFrame, name: str, pixels: str, width: int, height: int, target: str) -> DataFrame:
    """A folder of one PNG for each row, and (name, size, sha256, error) of each; error is null.

    pixels: bytes r, g, b. Tasks write beside the target, each file under another name
    first, so a task that is run again leaves the same file; then the folder is renamed. An existing
    target is never replaced, and a failed write leaves nothing. Pixels that are null
    or of another size, a null name, one that leads out of the folder, and one that another row has
    too are errors (ValueError, naming up to 20 of them), and then no folder appears.
    The rows are kept in the folder, under `_frames`.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    final = jvm.org.apache.hadoop.fs.Path(target)
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(target)
    stage = f"{target.rstrip('/')}.stage-{uuid.uuid4().hex[:8]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pyarrow.fs.FileSystem.from_uri(stage)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                called, cell = (batch.column(c)[i].as_py() for c in range(2))
                if not called or "/" in called or called in (".", ".."):
                    out.append((called, None, None, "name"))
                    continue
                if cell is None or len(cell) != width * height * 3:
                    out.append((called, None, None, "pixels"))
                    continue
                data = png(np.frombuffer(cell, np.uint8).reshape(height, width, 3))
                store.create_dir(folder, recursive=True)
                own = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as file:
                    file.write(data)
                store.move(own, f"{folder}/{called}")
                out.append((called, len(data), hashlib.sha256(data).hexdigest(), None))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["name", "size", "sha256", "error"])

    listed = f"{stage}-rows"
    staged = jvm.org.apache.hadoop.fs.Path(stage)
    try:
        df.select(name, pixels).mapInArrow(run, "name string, size long, sha256 string, error string").write.parquet(listed)
        rows = spark.read.parquet(listed)
        twice = rows.groupBy("name").count().where("name IS NOT NULL AND count > 1")
        if rows.where("error IS NOT NULL").isEmpty() and twice.isEmpty():
            fs.mkdirs(staged)
            if not fs.exists(final):
                # The list moves in with the frames it tells of.
                fs.rename(jvm.org.apache.hadoop.fs.Path(listed), jvm.org.apache.hadoop.fs.Path(f"{stage}/_frames"))
            if fs.exists(final) or not fs.rename(staged, final):
                raise FileExistsError(target)
            return spark.read.parquet(f"{target.rstrip('/')}/_frames")
        known = rows.join(twice.select("name").withColumnRenamed("name", "__twice"), rows["name"] == F.col("__twice"), "left")
        faults = known.select("name", "size", "sha256", F.coalesce("error", F.when(F.col("__twice").isNotNull(), "duplicate")).alias("error")).where("error IS NOT NULL")
        raise ValueError("frames: " + ", ".join(f"{r['name']} {r['error']}" for r in faults.orderBy("name").limit(20).collect()))
    finally:
        for path in (staged, jvm.org.apache.hadoop.fs.Path(listed)):
            if fs.exists(path):
                fs.delete(path, True)
