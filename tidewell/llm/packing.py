"""Packing by concatenation and cutting.

All documents form one stream of ids; windows of a fixed length cut it. Two
passes give every document its place: the first encodes each scan partition,
writes its ids with their place inside the partition to the shared folder, and
sums each partition; the prefix sums of those totals (one number for each
partition) are the global offsets with which the second pass cuts windows. A
document over a border gives one record on either side, also where the border
window is shared by two partitions. Only the last window is padded.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; ids may be of any type, a null one stays null; an empty table gives no pieces; columns
other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import dotted, map_arrow, materialise
from tidewell.llm.tokenise import encoder

SEQUENCE_TOKENS = 2048
END_ID = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODED = "part long, local_start long, n long, ids binary"


def _encode(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        kind = np.dtype("<u2") if max(enc.vocabulary, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], kind).tobytes()
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                piece = batch.slice(row, 512)
                ids = [np.frombuffer(enc.encode(t or ""), "<u4").astype(kind).tobytes() + end for t in piece.column("text").to_pylist()]
                n = np.array([len(x) // kind.itemsize for x in ids], np.int64)
                starts = at + np.concatenate(([0], np.cumsum(n)[:-1]))
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary()), piece.column("doc_id")], ["part", "local_start", "n", "ids", "doc_id"])

    return run


def _cut(offsets: dict[int, int], length: int, kind: pa.DataType):
    types = pa.schema([("doc_id", kind), *[(c.split()[0], pa.int64()) for c in PIECES.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part, local, n, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "n", "doc_id", "ids")), strict=True):
                at, wide = offsets[part] + local, np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                start = 0
                while start < n:
                    window, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    out.append((doc, start, size, zlib.crc32(wide[start : start + size]), n, window, offset))
                    start += size
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE_TOKENS, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece of a document in a window.

    The first pass runs at once. What the driver holds is one total for each
    partition of the scan, which Spark's scheduler holds as well.
    """
    rows = docs.select(dotted(id_column).alias("doc_id"), dotted(text_column).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    stored = materialise(map_arrow(rows, _encode(tokenizer_path, end_id), f"{_ENCODED}, doc_id {kind.simpleString()}"), "packed-ids")
    offsets, at = {}, 0
    for part, total in sorted((r["part"], r["total"]) for r in stored.groupBy("part").agg(F.sum("n").alias("total")).collect()):
        offsets[part], at = at, at + total
    return map_arrow(stored, _cut(offsets, length, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {PIECES}")
