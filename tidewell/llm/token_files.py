"""Token ids in files whose document boundaries are Elias-Fano encoded.

A shard file holds the concatenated ids of consecutive documents, 2 or 4 bytes
each, and two non-decreasing sequences in Elias-Fano form: the end of each
document in the id array, and the documents' own ids less the smallest. Of n
values below u each takes about 2 + log2(u / n) bits; a sample of every 512th
set bit lets select(i) find value i without a table of 64-bit offsets.

File: a header of nine little-endian unsigned 64-bit integers (magic, bytes an
id, documents, ids, documents of null id, smallest doc_id offset by 2**63, bytes
of the three sections), then the sections: boundaries, doc_ids, ids.

Defined results: a null or empty text is the end id alone; documents of null
doc_id, or of one that is no integer, come first; repeated doc_ids are ordered by text; an empty table gives no
file and no row; columns other than the id and the text are neither read nor
returned.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import dotted, filesystem, map_arrow, materialise, scratch
from tidewell.llm.tokenise import encoder

END_ID = 2
#: Ids after which a task begins another shard; it bounds what a task holds.
SHARD_IDS = 8 << 20
#: Tasks that read shards, at most.
READ_TASKS = 20_000
_MAGIC = int.from_bytes(b"TWEFIDS1", "little")
_HEADER = struct.Struct("<9Q")
_EVERY = 512
_ENTRY = "part long, seq long, path string, n_docs long, n_ids long"


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.width, self.low, self.high, self.sample = n, width, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        lows = values & np.uint64((1 << width) - 1)
        bits = ((lows[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        mask = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        mask[ones] = 1
        return cls(n, width, np.packbits(bits.ravel(), bitorder="little"), np.packbits(mask, bitorder="little"), ones[::_EVERY].astype(np.uint32))

    def tobytes(self) -> bytes:
        return struct.pack("<4Q", self.n, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.sample.astype("<u4").tobytes()

    @classmethod
    def frombytes(cls, data) -> EliasFano:
        n, width, low, high = struct.unpack_from("<4Q", data)
        body = np.frombuffer(data, np.uint8)[32:]
        return cls(n, width, body[:low], body[low : low + high], body[low + high :].view("<u4") if len(body) > low + high else np.zeros(0, "<u4"))

    def _low(self, i: int) -> int:
        first = i * self.width
        word = int.from_bytes(self.low[first // 8 : (first + self.width) // 8 + 1].tobytes(), "little")
        return (word >> first % 8) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Value i: from the nearest sampled set bit on, whole bytes are skipped by their counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.sample[i // _EVERY]), i % _EVERY
        byte = at // 8
        window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        window[: at % 8] = 0
        while left >= (n := int(window.sum())):
            left -= n
            byte += 1
            window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        at = byte * 8 + int(np.flatnonzero(window)[left])
        return ((at - i) << self.width) | self._low(i)

    def selects(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1: the set bits from one sampled bit on, up to the sample after the last."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.int64)
        block, after = first // _EVERY, (last - 1) // _EVERY + 1
        begin = int(self.sample[block])
        byte, end = begin // 8, int(self.sample[after]) // 8 + 1 if after < len(self.sample) else len(self.high)
        window = np.unpackbits(self.high[byte:end], bitorder="little")
        window[: begin - 8 * byte] = 0
        skipped = first - block * _EVERY
        ones = np.flatnonzero(window)[skipped : skipped + last - first] + 8 * byte
        low = first * self.width
        bits = np.unpackbits(self.low[low // 8 : -(-last * self.width // 8)], bitorder="little")[low % 8 :][: (last - first) * self.width]
        lows = (bits.reshape(last - first, self.width).astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return ((ones - np.arange(first, last)) << self.width) | lows

    def all(self) -> np.ndarray:
        """All values."""
        return self.selects(0, self.n)


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One shard of documents in ascending order, null ids first; ids: arrays of `width` bytes an id."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // width for x in ids])
    first = EliasFano.of(ends).tobytes()
    second = EliasFano.of(known.astype(np.uint64) - np.uint64(least % (1 << 64))).tobytes()
    body = b"".join(ids)
    return _HEADER.pack(_MAGIC, width, len(ids), len(body) // width, nulls, least + (1 << 63), len(first), len(second), len(body)) + first + second + body


class Shard:
    """A shard file, read by position: the two sequences at once, ids as they are asked for."""

    def __init__(self, data):
        """data: the file's bytes, or an open file of random access."""
        self.file = pa.BufferReader(data) if isinstance(data, bytes) else data
        magic, self.width, self.n_docs, self.n_ids, self.nulls, least, a, b, c = _HEADER.unpack(self.file.read_at(_HEADER.size, 0))
        if magic != _MAGIC or self.file.size() != _HEADER.size + a + b + c:
            raise ValueError("not a whole shard file")
        self.least, self.at = least - (1 << 63), _HEADER.size + a + b
        self.ends = EliasFano.frombytes(self.file.read_at(a, _HEADER.size))
        self.docs = EliasFano.frombytes(self.file.read_at(b, _HEADER.size + a))

    def doc_ids(self, first: int = 0, last: int | None = None) -> list[int | None]:
        """The documents' ids, of documents first to last - 1."""
        last = self.n_docs if last is None else last
        known = self.docs.selects(max(0, first - self.nulls), max(0, last - self.nulls))
        return [None] * max(0, min(last, self.nulls) - first) + (known + self.least).tolist()

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Token ids start to end - 1."""
        return np.frombuffer(self.file.read_at((end - start) * self.width, self.at + start * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, by two selects."""
        return self.tokens(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray, list[np.ndarray]]]:
        """(document ids, ends, token ids of each) of all documents, as many at a time as one sample of select spans."""
        start = 0
        for first in range(0, self.n_docs, _EVERY):
            last = min(first + _EVERY, self.n_docs)
            ends = self.ends.selects(first, last)
            ids = self.tokens(start, int(ends[-1]))
            yield self.doc_ids(first, last), ends, np.split(ids, ends[:-1] - start)
            start = int(ends[-1])


def _write(tokenizer_path: str, end_id: int, folder: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc = TaskContext.get(), encoder(tokenizer_path)
        kind = np.dtype("<u2") if max(enc.vocabulary, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        end, fs_root = np.array([end_id], kind).tobytes(), filesystem(folder)
        docs: list[int | None] = []
        ids: list[bytes] = []
        held, seq = 0, 0

        def flush() -> pa.RecordBatch:
            fs, root = fs_root
            name = f"{root}/shard-{context.partitionId():06d}-{seq:06d}.efids"
            fs.create_dir(root, recursive=True)
            # Written aside and renamed: a lost or repeated attempt leaves no half file.
            with fs.open_output_stream(aside := f"{name}.{context.taskAttemptId()}") as out:
                out.write(shard_bytes(docs, ids, kind.itemsize))
            fs.move(aside, name)
            entry = [context.partitionId(), seq, name, len(docs), held]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in entry], ["part", "seq", "path", "n_docs", "n_ids"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                one = np.frombuffer(enc.encode(text or ""), "<u4").astype(kind).tobytes() + end
                docs.append(doc)
                ids.append(one)
                held += len(one) // kind.itemsize
                if held >= shard_ids:
                    yield flush()
                    docs, ids, held, seq = [], [], 0, seq + 1
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write shards in ascending order of the id; returns a row for each shard with the ids before it.

    What the driver holds is one total for each task that wrote.
    """
    spark = docs.sparkSession
    rows = docs.select(dotted(id_column).try_cast("long").alias("doc_id"), dotted(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    entries = materialise(map_arrow(ordered, _write(tokenizer_path, end_id, folder, shard_ids), _ENTRY), "shards")
    totals, at = [], 0
    for part, total in sorted((r["part"], r["total"]) for r in entries.groupBy("part").agg(F.sum("n_ids").alias("total")).collect()):
        totals.append((part, at))
        at += total
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return entries.join(spark.createDataFrame(totals, "part long, first long"), "part").withColumn("before", F.col("first") + F.coalesce(own, F.lit(0))).drop("first")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_file(path) as f:
                    at = before
                    for docs, ends, ids in Shard(f).documents():
                        starts = np.concatenate(([at], before + ends[:-1]))
                        at = before + int(ends[-1])
                        crcs = [zlib.crc32(x.astype("<u4")) for x in ids]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(before + ends - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(folder: str, entries: DataFrame) -> DataFrame:
    """One row for each document of the shards: its place, its length and the checksum of its ids."""
    tasks = max(1, min(READ_TASKS, entries.count()))
    return map_arrow(entries.select("path", "before").repartition(tasks), _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write docs to the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "token-files")
    return read(folder, write(docs, folder, tokenizer_path, **options))
