"""Media columns stored as content-defined chunks.

A payload of 8-bit samples is cut where a rolling gear hash of the last 32 bytes
has its low bits clear, so equal passages are cut alike wherever they stand.
Tasks compress the chunks that they have not met before into drafts and return the
ordered chunk list of each payload. Spark takes the first place of each digest over
all tasks and those chunks alone are copied to the packs, a few drafts at a time,
which then go: each chunk is stored once. A join on the digest then points the lists to it.
Reading follows the lists, checks each chunk's digest and puts the payload
together; the rows of a pack are read together.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts
have equal values; repeated rows give repeated rows; ids may be of any type, a null one stays null; an
empty table gives an empty table; columns other than the id and the text are
neither read nor returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Workspace, dotted, filesystem, map_arrow, scratch, slices, utf8

UNIT = 64
LEAST_CHUNK, MOST_CHUNK, CUT_BITS = 2 << 10, 64 << 10, 13
PACK_BYTES = 256 << 20
#: Parts in which drafts are copied and removed: so much less than two copies stand on disk.
ROUNDS = 4
#: Digests that a task remembers, to draft a chunk once; a chunk drafted again is not copied.
TASK_DIGESTS = 200_000
_LIST = "pack long, row long, n_bytes long, n long, digest binary, seq long, offset long, size long, chunk_bytes long"
_LIST_NAMES = [c.split()[0] for c in _LIST.split(", ")]
_FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def gear_table() -> np.ndarray:
    """A random 32-bit word for each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def gear(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' words, each shifted by its distance."""
    h = table[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(candidates: np.ndarray, n: int) -> list[int]:
    """Ends of the chunks of a payload of n bytes, given the ends that the hash allows."""
    out, at = [], 0
    while n - at > LEAST_CHUNK:
        k = int(np.searchsorted(candidates, at + LEAST_CHUNK))
        end = int(candidates[k]) if k < len(candidates) else n
        at = min(end, at + MOST_CHUNK, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, table, (fs, root) = TaskContext.get(), gear_table(), filesystem(folder)
        pack, row, seq, at = context.partitionId(), 0, 0, 0
        squeeze, seen, out, name = zstandard.ZstdCompressor(level=3), {}, None, ""

        def close() -> None:
            out.close()
            fs.move(f"{name}.{context.taskAttemptId()}", name)

        for batch in slices(batches):
            data, offsets = utf8(batch)
            allowed = np.flatnonzero((gear(data, table) & np.uint32((1 << CUT_BITS) - 1)) == 0) + 1
            rows: list[tuple] = []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                first, n = int(offsets[k]), int(offsets[k + 1] - offsets[k])
                size = max(UNIT, -(-n // UNIT) * UNIT)
                payload = data[first : first + n].tobytes() + bytes(size - n)
                own = allowed[np.searchsorted(allowed, first, "right") : np.searchsorted(allowed, first + n, "right")] - first if n > LEAST_CHUNK else allowed[:0]
                begin = 0
                for i, end in enumerate(cuts(own, size)):
                    chunk = payload[begin:end]
                    digest = hashlib.sha256(chunk).digest()
                    place = seen.get(digest)
                    if place is None:
                        if out is None:
                            name = f"{root}/{pack % ROUNDS}/pack-{pack:06d}-{seq:06d}"
                            fs.create_dir(f"{root}/{pack % ROUNDS}", recursive=True)
                            out, at = fs.open_output_stream(f"{name}.{context.taskAttemptId()}"), 0
                        frame = squeeze.compress(chunk)
                        out.write(frame)
                        place = (pack, seq, at, len(frame))
                        at += len(frame)
                        if len(seen) >= TASK_DIGESTS:
                            seen.clear()
                        seen[digest] = place
                        if at >= PACK_BYTES:
                            close()
                            out, seq = None, seq + 1
                    rows.append((doc, pack, row, n, i, digest, *place[1:], end - begin))
                    begin = end
                row += 1
            kinds = [batch.column("doc_id").type, *[pa.binary() if c == "digest" else pa.int64() for c in _LIST_NAMES]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", *_LIST_NAMES])
        if out is not None:
            close()

    return run


def _copy(drafts: str, folder: str, turn: int):
    """Pack files of the chunks at the given places of the drafts, and their new places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, (fs, root), source = TaskContext.get(), filesystem(folder), _Packs(drafts)
        pack, seq, at, out, name = context.partitionId() * ROUNDS + turn, 0, 0, None, ""

        def close() -> None:
            out.close()
            fs.move(f"{name}.{context.taskAttemptId()}", name)

        for batch in batches:
            places: list[tuple] = []
            for digest, from_pack, from_seq, offset, size in zip(*(batch.column(c).to_pylist() for c in ("digest", "pack", "seq", "offset", "size")), strict=True):
                if out is None:
                    name = f"{root}/pack-{pack:06d}-{seq:06d}"
                    fs.create_dir(root, recursive=True)
                    out, at = fs.open_output_stream(f"{name}.{context.taskAttemptId()}"), 0
                out.write(source.fetch(from_pack, from_seq, offset, size))
                places.append((digest, pack, seq, at, size))
                at += size
                if at >= PACK_BYTES:
                    close()
                    out, seq = None, seq + 1
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.binary()) for i, c in enumerate(zip(*places, strict=True))], ["digest", "at_pack", "seq", "offset", "size"])
        if out is not None:
            close()
        source.close()

    return run


class _Packs:
    """The pack files of a folder, some of them open."""

    def __init__(self, folder: str):
        self.fs, self.root = filesystem(folder)
        self.files: dict[str, pa.NativeFile] = {}

    def fetch(self, pack: int, seq: int, offset: int, size: int) -> bytes:
        name = f"{self.root}/pack-{pack:06d}-{seq:06d}"
        f = self.files.get(name)
        if f is None:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            f = self.files[name] = self.fs.open_input_file(name)
        return bytes(f.read_at(size, offset))

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def store(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the packs; returns one row for each chunk of each payload, pointing to the one copy of it."""
    work = Workspace(docs.sparkSession, "media")
    drafts = f"{work.path}/drafts"
    rows = docs.select(dotted(id_column).alias("doc_id"), dotted(text_column).cast("string").alias("text"))
    lists = work.write(map_arrow(rows, _store(drafts), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_LIST}"), "chunk-lists")
    place = F.struct("pack", "seq", "offset", "size")
    first = work.write(lists.groupBy("digest").agg(F.min(place).alias("place")).select("digest", "place.*"), "first")
    index = work.table("index", "digest binary, at_pack long, seq long, offset long, size long")
    for turn in range(ROUNDS):
        own = first.where(F.col("pack") % ROUNDS == turn).repartition("pack", "seq").sortWithinPartitions("pack", "seq", "offset")
        index.add(map_arrow(own, _copy(f"{drafts}/{turn}", folder, turn), index.schema))
        work.remove(f"{drafts}/{turn}")
    return work.result(lists.drop("seq", "offset", "size").join(index.rows().hint("merge"), "digest").select("doc_id", "pack", "row", "n_bytes", "n", "digest", "chunk_bytes", "at_pack", "seq", "offset", "size"))


def samples_feature(payload: bytes) -> str:
    """Mean, deviation, peak and mean step of the samples, and how many values occur."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, values = len(x), np.arange(256)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum())
    deviation = max(0.0, squares / n - (total / n) ** 2) ** 0.5
    return f"{total / n:.4f}:{deviation:.4f}:{int(np.flatnonzero(counts)[-1])}:{steps / max(1, n - 1):.4f}:{int(np.count_nonzero(counts))}"


def _load(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, expand = _Packs(folder), zstandard.ZstdDecompressor()

        def done() -> tuple:
            payload, media = b"".join(parts), b"".join(frames)
            return (doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), samples_feature(payload))

        key, parts, frames, doc, n_bytes = None, [], [], None, 0
        names = ["doc_id", *[c.split()[0] for c in _FEATURES.split(", ")]]
        kinds = [pa.null(), *[pa.string() if c.endswith("string") else pa.int64() for c in _FEATURES.split(", ")]]
        for batch in batches:
            out = []
            kinds[0] = batch.column("doc_id").type
            for d, pack, row, nb, n, digest, _, at_pack, seq, offset, size in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if (pack, row) != key:
                    if key is not None:
                        out.append(done())
                    key, parts, frames, doc, n_bytes = (pack, row), [], [], d, nb
                frame = packs.fetch(at_pack, seq, offset, size)
                chunk = expand.decompress(frame)
                if n != len(parts) or hashlib.sha256(chunk).digest() != digest:
                    raise ValueError(f"chunk {n} of document {d} is not what was stored")
                parts.append(chunk)
                frames.append(frame)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), kinds, strict=True)], names)
        packs.close()

    return run


def load(stored: DataFrame, folder: str) -> DataFrame:
    """Features of each payload, put together from its verified chunks."""
    columns = ["doc_id", "pack", "row", "n_bytes", "n", "digest", "chunk_bytes", "at_pack", "seq", "offset", "size"]
    near = stored.select(*columns).repartition("pack", F.expr("row div 256")).sortWithinPartitions("pack", "row", "n")
    return map_arrow(near, _load(folder), f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {_FEATURES}")


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store docs in the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "media")
    return load(store(docs, folder, id_column, text_column), folder)
