"""Removal of passages that repeat, byte for byte, anywhere in the corpus.

Every byte covered by a string of LENGTH bytes that also starts elsewhere is
found exactly, by merging Burrows-Wheeler transforms of shards.

0. Equal texts are one text from here on, marked as standing in two places, and what
   becomes of it is worked out once; rows get it by its digest at the end.
1. Strings of LENGTH bytes are dealt by content: the anchor of one is its PIECE
   bytes of least hash, so equal strings have equal anchors at equal places.
   Neighbouring strings with one anchor form a segment of under 2 * LENGTH bytes.
2. Equal segments are counted first; all their strings repeat. Inside a task they
   are compared byte by byte; between tasks two hashes of 64 bits, the anchor's and
   the segment's, stand for the bytes. An anchor that only one segment has needs
   nothing more.
3. The different segments of one anchor are compared: tasks build the transform of
   each shard of segments, and merge the shards by interleave refinement. The
   interleave by the first symbol is refined round by round: a row's place by its
   first 2h symbols follows from its place by h symbols and that of the row h
   symbols on, which the transforms give as powers of their LF mapping. Rows of a
   shard are in order already, so a round merges runs and sorts nothing anew. After
   LENGTH symbols, rows of one place have a common prefix of LENGTH bytes: the
   repeated intervals.
4. Anchors of more than HOT segments, counted over all tasks, are split before
   that: by cells of the anchor's places, ever smaller ones, and by the bytes which
   all strings of a cell share. Equal strings stay together, and after the last
   split only equal strings are.

Defined results: a null or empty text has no bytes; equal texts of LENGTH bytes or
more are removed whole; repeated rows give repeated rows; a null doc_id stays
null, and ids may be of any type; an empty table gives an empty table; columns
other than the id and the text are neither read nor returned by `spans`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Workspace, dotted, map_arrow, text_id, utf8

LENGTH = 200
PIECE = 64
#: Segments of one anchor above which it is split; also a bound of a group in a task.
HOT = 512
#: Places of an anchor that a cell holds, from split to split.
CELLS = (64, 16, 4, 1)
#: Hot anchors that are broadcast, 8 bytes each; more of them are joined by a shuffle.
HOT_BROADCAST = 500_000
#: Segments that a task counts together, bytes of a shard, and bytes of a merged block.
COUNTED, SHARD, BLOCK = 100_000, 32 << 10, 128 << 10
#: Bytes of text that are handled at once; longer texts are cut with an overlap.
STRETCH = 512 << 10
_PLACE = np.uint64((1 << 24) - 1)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEGMENTS = "tid binary, start long, len int, ahead int, anchor long, segment long, twice boolean"
_NAMES = [c.split()[0] for c in _SEGMENTS.split(", ")]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, and a random word for each byte."""

    def __init__(self):
        self.words = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.base, self.back = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.back)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


def pieces(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of the PIECE bytes from each place on (the last places see fewer)."""
    h = words[data]
    k = 1
    while k < PIECE:
        h[:-k] = h[:-k] * _A + h[k:] if len(h) > k else h[:0]
        h ^= h >> np.uint64(29)
        k *= 2
    return mixed(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.uint64(2**64 - 1))
    padded[: len(x)] = x
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """(first place, bytes, bytes before the anchor, anchor hash, segment hash) over stretches of data."""
    width = LENGTH - PIECE + 1
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    h = pieces(data, powers.words)
    n = len(data) - LENGTH + 1
    least = sliding_least((h[: len(data) - PIECE + 1] & ~_PLACE) | np.arange(len(data) - PIECE + 1, dtype=np.uint64), width)
    anchor = (least & _PLACE).astype(np.int64)
    # Strings must lie in one stretch.
    inside = np.zeros(len(data) + 1, np.int64)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside)[:n] > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    first, final = np.flatnonzero(new), np.flatnonzero(last)
    # A stretch ends where the next begins, and both may share an anchor: strings over the border are none.
    at = anchor[first]
    up, down = powers.upto(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(powers.words[data] * up[: len(data)], dtype=np.uint64)))
    stop = final + LENGTH
    return first, stop - first, at - first, h[at], mixed((sums[stop] - sums[first]) * down[first])


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, row of each stretch, place of the stretch in its text)."""
    data, at = utf8(batch)
    if len(data) <= STRETCH + LENGTH:
        yield data, at[:-1], at[1:], np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        return
    for row in range(batch.num_rows):
        for first in range(int(at[row]), max(int(at[row + 1]) - LENGTH + 1, int(at[row]) + 1), STRETCH):
            part = data[first : min(first + STRETCH + LENGTH - 1, int(at[row + 1]))]
            yield part, np.array([0]), np.array([len(part)]), np.array([row]), np.array([first - at[row]])


def equal(data: list[bytes], owner: np.ndarray, first: np.ndarray, last: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each segment, whether it has others, whether it stands for them): equal bytes, found by hash and compared.

    A segment whose bytes are not those of its hash's first one gets another hash, in place.
    """
    while True:
        _, where, count = np.unique(segment, return_inverse=True, return_counts=True)
        order = np.argsort(where, kind="stable")
        begins = np.concatenate(([True], where[order][1:] != where[order][:-1]))
        lead = np.zeros(len(where), bool)
        lead[order[begins]] = True
        at = order[~begins]
        to = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))[~begins]]
        odd: list[int] = []
        for k in range(0, len(at), 8192):
            own, other = at[k : k + 8192], to[k : k + 8192]
            columns = [x.tolist() for x in (own, owner[own], first[own], last[own], owner[other], first[other], last[other])]
            odd += [i for i, o, a, b, p, c, d in zip(*columns, strict=True) if data[o][a:b] != data[p][c:d]]
        if not odd:
            return where, count[where] > 1, lead
        for i in odd:
            segment[i] = xxhash.xxh64_intdigest(data[owner[i]][first[i] : last[i]], int(segment[i]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments; those that the task has more than once as known spans (anchor null) and one row."""
    powers = Powers()
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        tids = pa.concat_arrays([h[0] for h in held]).cast(pa.binary())
        start, length, ahead, anchor, segment = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
        first, owner = np.concatenate([h[7] for h in held]), np.repeat(np.arange(len(held)), [len(h[7]) for h in held])
        where, many, lead = equal([h[6] for h in held], owner, first, first + length, segment)
        # A text that stands in two places goes as a whole; its segments only tell of others.
        again = np.concatenate([h[8] for h in held])
        many |= np.bincount(where, again)[where] > 0
        one = np.flatnonzero(lead)
        known = np.flatnonzero(many & ~again)
        # Known spans of neighbouring segments of one text are put together.
        if len(known):
            rows = np.concatenate([np.full(len(h[0]), i) for i, h in enumerate(held)])
            joins = np.zeros(len(known), bool)
            joins[1:] = (np.diff(known) == 1) & (start[known][1:] > start[known][:-1]) & (start[known][1:] <= (start + length)[known][:-1]) & (rows[known][1:] == rows[known][:-1])
            same_text = np.array(tids.take(pa.array(known[1:])).to_pylist(), object) == np.array(tids.take(pa.array(known[:-1])).to_pylist(), object) if len(known) > 1 else np.zeros(0, bool)
            joins[1:] &= same_text
            head = np.flatnonzero(~joins)
            tail = np.append(head[1:] - 1, len(known) - 1)
            known_start, known_end = start[known[head]], (start + length)[known[tail]]
            known = known[head]
        else:
            known_start = known_end = np.zeros(0, np.int64)
        take = pa.array(np.concatenate((one, known)))
        none = np.concatenate((np.zeros(len(one), bool), np.ones(len(known), bool)))
        out = [
            tids.take(take),
            pa.array(np.concatenate((start[one], known_start))),
            pa.array(np.concatenate((length[one], np.minimum(known_end - known_start, 2**31 - 1))).astype(np.int32)),
            pa.array(np.concatenate((ahead[one], np.zeros(len(known), np.int64))).astype(np.int32)),
            pa.array(np.concatenate((anchor[one].view(np.int64), np.zeros(len(known), np.int64))), mask=none),
            pa.array(np.concatenate((segment[one].view(np.int64), np.zeros(len(known), np.int64))), mask=none),
            pa.array(np.concatenate((many[one], np.ones(len(known), bool)))),
        ]
        return pa.RecordBatch.from_arrays(out, _NAMES)

    for batch in _unpack(batches):
        for data, starts, ends, rows, place in _stretches(batch):
            first, length, ahead, anchor, segment = segments(data, starts, ends, powers)
            if not len(first):
                continue
            own = np.searchsorted(starts, first, "right") - 1
            tids, again = (batch.column(c).take(pa.array(rows[own])) for c in ("tid", "again"))
            held.append((tids, first - starts[own] + place[own], length, ahead, anchor, segment, data.tobytes(), first, np.array(again)))
            size += len(first)
        if size >= COUNTED:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments asked for in each text."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for tid, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("tid", "packed", "wanted")), strict=True):
            text = expand.decompress(packed)
            out.extend((w["anchor"], tid, w["start"], w["ahead"], w["twice"], text[w["start"] : w["start"] + w["len"]]) for w in wanted)
            if len(out) > 10_000:
                yield _bytes_batch(out)
                out = []
        if out:
            yield _bytes_batch(out)


_BYTES = "key long, tid binary, start long, ahead int, twice boolean, bytes binary"
_READY = "key long, tid binary, start long, twice boolean, bytes binary"
_READY_NAMES = [c.split()[0] for c in _READY.split(", ")]
_BYTE_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]


def _bytes_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BYTE_TYPES, strict=True)], [c.split()[0] for c in _BYTES.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are dealt out twice."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [squeeze.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c != "text"] + [pa.array(packed, pa.binary())], [c for c in batch.schema.names if c != "text"] + ["packed"])


def _unpack(batches: Iterator[pa.RecordBatch], most: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """(tid, again, text) with the bytes of packed texts, about `most` of them at once; a longer text is alone."""
    expand = zstandard.ZstdDecompressor()
    names = ["tid", "again", "text"]
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for tid, again, packed in zip(*(batch.column(c).to_pylist() for c in ("tid", "again", "packed")), strict=True):
            n = zstandard.frame_content_size(packed)
            if held and size + n > most:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.binary(), pa.bool_(), pa.binary()), strict=True)], names)
                held, size = [], 0
            held.append((tid, again, expand.decompress(packed)))
            size += n
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.binary(), pa.bool_(), pa.binary()), strict=True)], names)


def _halves(size: int):
    """Segments cut so that the anchor's place in their strings falls in one cell of `size` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, tid, start, ahead, twice, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                lowest = ahead - (len(data) - LENGTH)
                for cell in range(lowest // size, ahead // size + 1):
                    low, high = max(lowest, cell * size), min(ahead, cell * size + size - 1)
                    part = data[ahead - high : ahead - low + LENGTH]
                    core = data[ahead - cell * size : ahead + LENGTH - (cell * size + size - 1)]
                    name = xxhash.xxh64_intdigest(core, (key ^ cell * 0x9E3779B97F4A7C15) % (1 << 64))
                    out.append((name - (1 << 64) if name >> 63 else name, tid, start + ahead - high, high, twice, part))
                if len(out) > 10_000:
                    yield _bytes_batch(out)
                    out = []
            if out:
                yield _bytes_batch(out)

    return run


class Transform:
    """Burrows-Wheeler transform of a shard of strings, each with its own terminator."""

    def __init__(self, strings: list[bytes]):
        m = len(strings)
        lengths = np.array([len(s) for s in strings])
        ends = np.cumsum(lengths + 1) - 1
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + m
        text[ends] = np.arange(m)
        n, bits = len(text), int(255 + m).bit_length()
        depth = max(1, 62 // bits)
        padded = np.concatenate((text, np.zeros(depth, np.int64)))
        key = np.zeros(n, np.int64)
        for k in range(depth):
            key = key << bits | padded[k : k + n]
        order = np.argsort(key)
        k = key[order]
        # A row's rank is the place of the first row that is equal so far; only rows of such groups are sorted on.
        new = np.concatenate(([True], k[1:] != k[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = head
        while True:
            tied = ~new
            tied[:-1] |= ~new[1:]
            rows = np.flatnonzero(tied)
            if not len(rows):
                break
            # Terminators differ, so a string's end settles the order before another string could matter.
            own = order[rows]
            nxt = np.where(own + depth < n, rank[np.minimum(own + depth, n - 1)], 0)
            key = head[rows] * n + nxt
            by = np.argsort(key)
            own, k = own[by], key[by]
            order[rows] = own
            fresh = np.concatenate(([True], k[1:] != k[:-1]))
            new[rows] = fresh
            head[rows] = np.maximum.accumulate(np.where(fresh, rows, 0))
            rank[own] = head[rows]
            depth *= 2
        self.order = order
        self.symbols = np.where(text < m, 0, text - m + 1).astype(np.int16)
        #: The symbol before each row's suffix, rows in order: the transform.
        self.bwt = self.symbols[order - 1]
        #: First symbol of each row, and the row of the suffix one symbol on, both from the transform alone.
        self.first = np.sort(self.bwt, kind="stable")
        self.step = np.argsort(self.bwt, kind="stable")
        stop = self.first == 0
        self.step[stop] = np.flatnonzero(stop)
        begins = np.concatenate(([0], ends[:-1] + 1))
        self.string = np.searchsorted(begins, order, "right") - 1
        self.place = order - begins[self.string]
        #: Rows whose suffix has LENGTH bytes at least.
        self.whole = lengths[self.string] - self.place >= LENGTH


def refine(shards: list[Transform], length: int = LENGTH) -> list[np.ndarray]:
    """For each shard the place of its rows in the merged order by their first `length` symbols.

    Rows with equal places have a common prefix of that length.
    """
    cuts = np.cumsum([0] + [len(s.step) for s in shards])
    # Jumps lead from row to row of the own shard; numbers run on from shard to shard.
    jump = np.concatenate([s.step + c for s, c in zip(shards, cuts[:-1], strict=True)])
    place = np.concatenate([s.first for s in shards]).astype(np.int64)
    kept: dict[int, np.ndarray] = {}
    h = 1
    while h < length:
        if h + h <= length:
            far, grown = jump, 2 * h
        else:  # the last round reaches length exactly: a jump of length - h from the powers of two
            far, left = np.arange(len(place)), length - h
            for p in sorted(kept):
                if left & p:
                    far = kept[p][far]
            grown = length
        key = place * (int(place.max()) + 1) + place[far]
        order = np.argsort(key, kind="stable")  # runs in order, one for each shard, are merged
        k = key[order]
        place = np.empty(len(key), np.int64)
        place[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        kept[h] = jump
        if grown == 2 * h:
            jump = jump[jump]
        h = grown
    return [place[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def repeated(strings: list[bytes], twice: list[bool]) -> list[list[tuple[int, int]]]:
    """For each string the spans covered by strings of LENGTH bytes that start twice or more in all of them.

    twice: strings that are known to stand in two places.
    """
    groups, size = [[]], 0
    for i, s in enumerate(strings):
        if size + len(s) > SHARD and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(s)
    shards = [Transform([strings[i] for i in g]) for g in groups]
    places = refine(shards)
    weight = [np.array([2 if twice[i] else 1 for i in g]) for g in groups]
    count = np.zeros(max(int(p.max()) for p in places) + 1, np.int64)
    for s, p, w in zip(shards, places, weight, strict=True):
        count += np.bincount(p[s.whole], w[s.string[s.whole]], len(count)).astype(np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for g, s, p in zip(groups, shards, places, strict=True):
        hit = np.flatnonzero(s.whole & (count[p] > 1))
        string, place = s.string[hit], s.place[hit]
        order = np.lexsort((place, string))
        string, place = string[order], place[order]
        new = np.ones(len(string), bool)
        new[1:] = (string[1:] != string[:-1]) | (place[1:] - place[:-1] > LENGTH)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(string)) - 1
        for x, a, b in zip(string[head], place[head], place[tail] + LENGTH, strict=True) if len(string) else ():
            out[g[x]].append((int(a), int(b)))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of segments, of rows sorted by key; whole groups make up a block."""

    def done() -> pa.RecordBatch:
        rows = []
        for (tid, start, again, _), spans in zip(block, repeated([x[3] for x in block], [x[2] for x in block]), strict=True):
            if not again:  # the others are spans as a whole already
                rows.extend((tid, start + a, b - a) for a, b in spans)
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["tid", "start", "len"])

    block: list[tuple] = []
    size, last, first = 0, None, 0

    def alone() -> int:
        """A key with one segment has nothing to be compared with, and goes."""
        return len(block.pop()[3]) if len(block) - first == 1 else 0

    for batch in batches:
        for key, tid, start, again, data in zip(*(batch.column(c).to_pylist() for c in ("key", "tid", "start", "twice", "bytes")), strict=True):
            if key != last:
                size -= alone()
                if size >= BLOCK:
                    yield done()
                    block, size = [], 0
                first = len(block)
            block.append((tid, start, again, data))
            size += len(data)
            last = key
    alone()
    if block:
        yield done()


def repeated_spans(texts: DataFrame, work: Workspace) -> DataFrame:
    """(tid, start, len) of spans that repeat; they may overlap.

    texts: (tid, packed, again), one row for each different text; again: it stands in two places or more.
    Of such a text no span need be found here: it repeats from end to end.

    What is known is added to two tables as it comes, spans and segments to be
    merged, so that no plan grows with the number of splits.
    """
    found = work.write(map_arrow(texts, _find, _SEGMENTS), "segments")
    spans, ready = work.table("spans", "tid binary, start long, len int"), work.table("ready", _READY)
    spans.add(found.where(F.col("anchor").isNull()).select("tid", "start", "len"))
    rows = found.where(F.col("anchor").isNotNull())
    hot = work.write(rows.groupBy("anchor").count().where(F.col("count") >= HOT).select("anchor"), "hot")
    hot = F.broadcast(hot) if hot.count() <= HOT_BROADCAST else hot.hint("merge")
    even = rows.join(hot, "anchor", "left_anti").repartition("anchor")
    same = Window.partitionBy("anchor", "segment")
    even = even.withColumn("repeats", F.sum(F.when(F.col("twice"), 2).otherwise(1)).over(same) > 1).withColumn("lead", F.row_number().over(same.orderBy("segment")) == 1)
    even = even.withColumn("kinds", F.sum(F.col("lead").cast("int")).over(Window.partitionBy("anchor")))
    even = even.where("repeats OR kinds > 1").select("tid", "start", "len", "ahead", "anchor", "repeats", (F.col("lead") & (F.col("kinds") > 1)).alias("compare"))
    even = work.write(even.where("repeats OR compare"), "counted")
    spans.add(even.where("repeats").select("tid", "start", "len"))
    ask = even.where("compare").select("tid", "start", "len", "ahead", "anchor", F.col("repeats").alias("twice"))
    ask = ask.unionAll(rows.join(hot, "anchor", "left_semi").select("tid", "start", "len", "ahead", "anchor", "twice"))
    wanted = ask.groupBy("tid").agg(F.collect_list(F.struct("start", "len", "ahead", "anchor", "twice")).alias("wanted"))
    packed = texts.select("tid", "packed")
    compared = work.write(map_arrow(packed.join(wanted.hint("merge"), "tid").select("tid", "packed", "wanted"), _fetch, _BYTES), "bytes")
    for size in CELLS:
        hot_keys = work.write(compared.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot-keys")
        n = hot_keys.count()
        if not n:
            break
        hot_keys = F.broadcast(hot_keys) if n <= HOT_BROADCAST else hot_keys.hint("merge")
        ready.add(compared.join(hot_keys, "key", "left_anti").select(*_READY_NAMES))
        split = compared.join(hot_keys, "key", "left_semi").select(*[c.split()[0] for c in _BYTES.split(", ")])
        cut = work.write(map_arrow(split, _halves(size), _BYTES).withColumn("segment", F.xxhash64("bytes")), "cut")
        # Of equal strings one goes on, and stands for all; the others are spans already.
        lead = F.min(F.struct("tid", "start", "ahead", "bytes")).alias("lead")
        compared = work.write(cut.groupBy("key", "segment").agg((F.sum(F.when(F.col("twice"), 2).otherwise(1)) > 1).alias("twice"), lead), "cells")
        again = compared.where("twice").select("key", "segment").hint("merge")
        spans.add(cut.select("key", "segment", "tid", "start", F.length("bytes").alias("len")).join(again, ["key", "segment"], "left_semi").select("tid", "start", "len"))
        compared = compared.select("key", "lead.tid", "lead.start", "lead.ahead", "twice", "lead.bytes")
    ready.add(compared.select(*_READY_NAMES))
    spans.add(map_arrow(ready.rows().repartition("key").sortWithinPartitions("key"), _merge, "tid binary, start long, len int"))
    return spans.rows()


def cut_out(data: bytes, spans: list) -> tuple[bytes, list[tuple[int, int]]]:
    """(bytes outside all spans, maximal covered runs)."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["start"] + s["len"]) for s in spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], b))
        else:
            runs.append((a, b))
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), runs


def cut_text(data: bytes, runs: list[tuple[int, int]]) -> str:
    """The text outside the runs; a character that a run cuts stays whole."""
    kept, at = [], 0
    for a, b in runs:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept).decode()


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, list[tuple[int, int]]]]:
    """(bytes, bytes that stay, runs that go) of each text."""
    expand = zstandard.ZstdDecompressor()
    for packed, again, spans in zip(*(batch.column(c).to_pylist() for c in ("packed", "again", "spans")), strict=True):
        data = expand.decompress(packed)
        whole = again and len(data) >= LENGTH
        yield data, *cut_out(data, [{"start": 0, "len": len(data)}] if whole else spans)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) for data, kept, runs in _cut(batch)]
        n, removed, runs, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["tid", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [cut_text(data, runs) for data, _, runs in _cut(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(out, pa.string())], ["tid", "__text"])


def _with_spans(rows: DataFrame, run, schema: str) -> DataFrame:
    """Rows (with tid and text), each with what `run` gives for its text."""
    work = Workspace(rows.sparkSession, "repeats")
    packed = map_arrow(rows.select("tid", "text"), _pack, "tid binary, packed binary")
    texts = work.write(packed.groupBy("tid").agg(F.first("packed").alias("packed"), (F.count("tid") > 1).alias("again")), "texts")
    spans = repeated_spans(texts, work).groupBy("tid").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    done = map_arrow(texts.join(spans.hint("merge"), "tid", "left"), run, schema)
    return work.result(rows.drop("text").join(done.hint("merge"), "tid").drop("tid"))


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    rows = docs.select(dotted(id_column).alias("doc_id"), text_id(text_column).alias("tid"), dotted(text_column).cast("string").alias("text"))
    return _with_spans(rows, _digest, "tid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents without the repeated bytes; all columns stay, in their order. A null text becomes empty."""
    others = [dotted(c).alias(c) for c in docs.columns if c != text_column]
    whole = F.struct(*others) if others else F.lit(None).cast("boolean")
    rows = docs.select(whole.alias("others"), text_id(text_column).alias("tid"), dotted(text_column).cast("string").alias("text"))
    cut = _with_spans(rows, _texts, "tid binary, __text string")
    return cut.select(*[F.col("__text").alias(c) if c == text_column else F.col("others").getField(c).alias(c) for c in docs.columns])
