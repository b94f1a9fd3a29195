"""Data source `recording`: boxes, trailer records and presentation times of capture files.

One file is one input partition and is read by position: box headers, the trailer
index and timing tables, never the media payload. Option `part` picks the rows:
boxes, records, or pts. A file that breaks a rule gives one row whose status says
which; other files are not touched by it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Fixed values of the format: the trailer's mark and sizes, and the parser's limits.
MAGIC = b"8db42d694ccc418790edff439fe026bf"
HEADER, FOOTER, ENTRY = 72, 6, 10
MAX_BOXES, MAX_INDEX, MAX_RECORDS, MAX_RECORD, MAX_SAMPLES = 4096, 1 << 20, 256, 512 << 20, 5_000_000

SCHEMAS = {
    "boxes": "path string, kind string, offset long, size long, status string",
    "records": "path string, id int, format int, offset long, size long, payload binary, status string",
    "pts": "path string, track int, ordinal long, pts_us long, status string",
}


class Malformed(ValueError):
    """A rule of the format is broken."""


@dataclass(frozen=True)
class Box:
    kind: bytes
    offset: int
    body: int
    end: int


class Capture:
    """A capture file that is read by position."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) != n:
            raise Malformed("truncated file")
        return data

    def box(self, offset: int, end: int) -> Box:
        if end - offset < 8:
            raise Malformed("truncated box header")
        size, kind = struct.unpack(">I4s", self.at(offset, 8))
        body = 8
        if size == 1:
            if end - offset < 16:
                raise Malformed("truncated box header")
            (size,), body = struct.unpack(">Q", self.at(offset + 8, 8)), 16
        elif size == 0:
            size = end - offset
        if not body <= size <= end - offset:
            raise Malformed("box size")
        return Box(kind, offset, offset + body, offset + size)

    def inside(self, start: int, end: int) -> list[Box]:
        found: list[Box] = []
        while start < end:
            if len(found) == MAX_BOXES:
                raise Malformed("too many boxes")
            found.append(self.box(start, end))
            start = found[-1].end
        return found

    def trailer(self) -> int | None:
        """Where the trailer's records begin; None if there is no trailer."""
        if self.size < 40:
            return None
        size, version, mark = struct.unpack("<II32s", self.at(self.size - 40, 40))
        if mark != MAGIC:
            return None
        if version != 3:
            raise Malformed("trailer version")
        if not HEADER <= size <= self.size:
            raise Malformed("trailer size")
        return self.size - size

    def layout(self) -> tuple[list[Box], int | None]:
        """Boxes of the top level up to the trailer, and where its records begin. The trailer starts between boxes or in a last box `inst` of a stated size."""
        records, at, found = self.trailer(), 0, []
        while at < self.size and at != records:
            if len(found) == MAX_BOXES:
                raise Malformed("too many boxes")
            box = self.box(at, self.size)
            if records is not None and box.end > records:
                wrapped = box.kind == b"inst" and box.body == at + 8 == records and box.end == self.size and self.at(at, 4) != bytes(4)
                if not wrapped:
                    raise Malformed("trailer inside a box")
            found.append(box)
            at = box.end
        return found, records

    def records(self) -> list[tuple[int, int, int, int]]:
        """(id, format, offset, size) of the trailer's records by id, from the index or, without one, by the footers from the end."""
        start = self.layout()[1]
        if start is None:
            raise Malformed("no trailer")
        end = self.size - HEADER
        if end == start:
            return []
        if end - start < FOOTER:
            raise Malformed("record footer")
        kind, number, size = struct.unpack("<BBI", self.at(end - FOOTER, FOOTER))
        if kind or number:
            return self._backwards(start, end)
        if size > MAX_INDEX or size % ENTRY or end - FOOTER - size < start:
            raise Malformed("record index")
        index, found = end - FOOTER - size, []
        for number, kind, length, relative in struct.iter_unpack("<BBII", self.at(index, size)):
            if not (number or kind or length or relative):
                continue
            if not number:
                raise Malformed("record id zero")
            if len(found) == MAX_RECORDS:
                raise Malformed("too many records")
            offset = start + relative
            if offset + length + FOOTER > index:
                raise Malformed("record bounds")
            if struct.unpack("<BBI", self.at(offset + length, FOOTER)) != (kind, number, length):
                raise Malformed("record footer differs")
            found.append((number, kind, offset, length))
        found.sort(key=lambda r: r[2])
        if any(a[2] + a[3] + FOOTER > b[2] for a, b in zip(found, found[1:], strict=False)):
            raise Malformed("records overlap")
        return sorted(found)

    def _backwards(self, start: int, end: int) -> list[tuple[int, int, int, int]]:
        found = []
        while end > start:
            if end - start < FOOTER:
                raise Malformed("partial record")
            if len(found) == MAX_RECORDS:
                raise Malformed("too many records")
            kind, number, size = struct.unpack("<BBI", self.at(end - FOOTER, FOOTER))
            end -= FOOTER + size
            if end < start:
                raise Malformed("record bounds")
            found.append((number, kind, end, size))
        return sorted(found, key=lambda r: r[0])

    def one(self, boxes: list[Box], kind: bytes) -> Box:
        same = [b for b in boxes if b.kind == kind]
        if len(same) != 1:
            raise Malformed(f"{kind.decode('latin-1')} missing or repeated")
        return same[0]

    def down(self, boxes: list[Box], *kinds: bytes) -> list[Box]:
        for kind in kinds:
            box = self.one(boxes, kind)
            boxes = self.inside(box.body, box.end)
        return boxes

    def timescale(self, box: Box) -> int:
        version = self.at(box.body, 1)[0]
        if version > 1:
            raise Malformed("header version")
        (scale,) = struct.unpack(">I", self.at(box.body + (20 if version else 12), 4))
        if not scale:
            raise Malformed("timescale")
        return scale

    def runs(self, box: Box, signed: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
        """(version, counts, values) of a table of runs."""
        version, n = self.at(box.body, 1)[0], struct.unpack(">I", self.at(box.body + 4, 4))[0]
        if box.end - box.body != 8 + 8 * n or n > MAX_SAMPLES:
            raise Malformed("run table")
        pairs = np.frombuffer(self.at(box.body + 8, 8 * n), ">u4").reshape(-1, 2)
        values = pairs[:, 1].astype("<u4")
        return version, pairs[:, 0].astype("int64"), (values.view("<i4") if signed and version == 1 else values).astype("int64")

    def edit(self, track: list[Box], scale: int | None) -> tuple[int, int, int | None, int]:
        """(media start, empty ticks before, ticks kept or None, ticks a second of the last two): one edit at rate one, perhaps after an empty one."""
        if not any(b.kind == b"edts" for b in track):
            return 0, 0, None, 1
        box = self.one(self.down(track, b"edts"), b"elst")
        data = self.at(box.body, box.end - box.body)
        if len(data) < 8 or data[0] > 1 or scale is None:
            raise Malformed("edit list")
        count, form = struct.unpack(">I", data[4:8])[0], (">Iii", ">Qqi")[data[0]]
        if count not in (1, 2) or len(data) != 8 + count * struct.calcsize(form):
            raise Malformed("edit list")
        *lead, (kept, start, _) = entries = list(struct.iter_unpack(form, data[8:]))
        if any(rate != 1 << 16 or not ticks for ticks, _, rate in entries) or start < 0 or any(s != -1 for _, s, _ in lead):
            raise Malformed("edit list")
        return start, lead[0][0] if lead else 0, kept, scale

    def pts(self) -> Iterator[np.ndarray]:
        """Presentation times of each video track in microseconds, strictly rising."""
        moov = self.down(self.layout()[0], b"moov")
        heads = [b for b in moov if b.kind == b"mvhd"]
        movie = self.timescale(heads[0]) if len(heads) == 1 else None
        left = MAX_SAMPLES
        for trak in (b for b in moov if b.kind == b"trak"):
            track = self.inside(trak.body, trak.end)
            media = self.down(track, b"mdia")
            if self.at(self.one(media, b"hdlr").body + 8, 4) != b"vide":
                continue
            scale, tables = self.timescale(self.one(media, b"mdhd")), self.down(media, b"minf", b"stbl")
            version, counts, deltas = self.runs(self.one(tables, b"stts"))
            total = int(counts.sum())
            if version or not 0 < total <= left or not (counts.all() and deltas.all()):
                raise Malformed("stts")
            if self.samples(tables) != total:
                raise Malformed("sample count")
            left -= total
            step = np.repeat(deltas, counts)
            ticks = np.cumsum(step) - step
            if any(b.kind == b"ctts" for b in tables):
                version, counts, shifts = self.runs(self.one(tables, b"ctts"), signed=True)
                if version > 1 or not counts.all() or int(counts.sum()) != total:
                    raise Malformed("ctts")
                ticks = ticks + np.repeat(shifts, counts)
            start, empty, kept, per = self.edit(track, movie)
            exact = ticks.astype(object) - start
            if kept is not None and ((exact < 0).any() or (exact * per >= kept * scale).any()):
                raise Malformed("edit drops samples")
            out = np.sort(rounded((exact * per + empty * scale) * 1_000_000, scale * per).astype("int64"))
            if (np.diff(out) <= 0).any():
                raise Malformed("times not unique")
            yield out

    def samples(self, tables: list[Box]) -> int:
        kinds = [b for b in tables if b.kind in (b"stsz", b"stz2")]
        if len(kinds) != 1:
            raise Malformed("stsz missing or repeated")
        return struct.unpack(">I", self.at(kinds[0].body + 8, 4))[0]


def rounded(numerator, denominator: int):
    """A ratio of exact integers to the nearest, halves away from zero."""
    size = (2 * abs(numerator) + denominator) // (2 * denominator)
    return size * ((numerator > 0) * 2 - 1)


def _opened(path: str):
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs.open_input_file(inner)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.part, self.path = options.get("part", "boxes"), options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.ids: set[int] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Record ids reach the reader, so that other payloads are not read."""
        for f in filters:
            if self.part == "records" and isinstance(f, EqualTo | In) and f.attribute == ("id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = wanted if self.ids is None else self.ids & wanted
            yield f  # malformed files have rows without id, so Spark filters again

    def partitions(self):
        from pyarrow.fs import FileSelector, FileSystem, FileType

        paths = []
        for path in self.path.split(","):
            fs, inner = FileSystem.from_uri(path if "://" in path else f"file://{path}")
            head = path[: len(path) - len(inner)] if "://" in path else ""
            if fs.get_file_info(inner).type == FileType.Directory:
                paths += [head + f.path for f in fs.get_file_info(FileSelector(inner)) if f.type == FileType.File]
            else:
                paths.append(path)
        return [_File(p) for p in sorted(set(paths))]

    def read(self, partition):
        path = partition.path
        with _opened(path) as file:
            capture = Capture(file, file.size())
            try:
                rows = list(getattr(self, f"_{self.part}")(capture)) if self.part != "pts" else self._pts(capture)
                for row in rows:
                    yield (path, *row, "ok")
            except Malformed as e:
                yield (path, *[None] * (SCHEMAS[self.part].count(",") - 1), str(e))

    def _boxes(self, capture: Capture):
        return [(b.kind.decode("latin-1"), b.offset, b.end - b.offset) for b in capture.layout()[0]]

    def _records(self, capture: Capture):
        for number, kind, offset, size in capture.records():
            if self.ids is None or number in self.ids:
                if self.payload and size > MAX_RECORD:
                    raise Malformed("record too large")
                yield number, kind, offset, size, capture.at(offset, size) if self.payload else None

    def _pts(self, capture: Capture):
        tracks = list(capture.pts())  # a broken track gives no rows of the tracks before it
        return ((k, i, int(t)) for k, times in enumerate(tracks) for i, t in enumerate(times))


class RecordingSource(DataSource):
    """spark.read.format("recording").option("part", "records").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "boxes")]

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
