"""Near-duplicate classes by Order MinHash with alignment checks.

A text is its sequence of five-word shingles, a shingle's occurrences told apart
by their number; a text of fewer words is one shingle. Each of SKETCHES sketches
takes the few shingles of smallest hash and keeps them in text order, so that two
texts agree on a sketch where they are alike in content and in order.

Equal texts are one node from the start. Texts of one sketch value are a bucket,
and two texts that share a bucket are candidates. In each bucket every text is
aligned with the bucket's hub; the links found join texts to classes. Every other
pair of a bucket whose classes still differ is settled in one pass: the bucket is
cut into blocks of bounded size, a task for each pair of blocks counts the shared
shingles of all its pairs exactly, and aligns those that can be links, the most
alike first, until they are in one class. So no pair that shares a bucket is lost;
a pair of texts is looked at in the first bucket that it shares only.

A link is an alignment of at least 0.8 of shared shingles over all: shingles
matched in order within the band that 0.8 leaves, or, where blocks were moved,
matched runs on any diagonal; the second is also taken over the first occurrences
of shingles alone, so that lines repeated more often in one text do not count.
Links are joined to classes by alternating star contraction, in Spark throughout.

Defined results: a null text is an empty one; texts without a word are classes
with their exact copies; repeated rows get the same class; class_id is the
smallest id of the class, null where all are null; ids of any type that can be
ordered; an empty table gives an empty table; columns other than the id and the
text are neither read nor returned. Of rows with one id and one text `keep_one`
keeps the one whose columns have the least hash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Workspace, dotted, map_arrow, slices, text_id
from tidewell.llm.tokenise import Memo

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, KEPT = 16, 2
#: Texts of a block, shingles of a block and columns of a step of counting: a task holds two blocks.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 19, 4096
_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output looks random."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts; words are remembered, a bounded number of them."""

    def __init__(self):
        self.memo = Memo(xxhash.xxh64_intdigest)

    def words(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.lower())
        return np.fromiter(map(self.memo.__getitem__, found), np.uint64, len(found))

    def shingles(self, text: str) -> np.ndarray:
        """One hash for each run of SHINGLE words, in text order."""
        w = self.words(text)
        n = len(w) - SHINGLE + 1
        if n < 1:
            w, n = np.concatenate([w, np.zeros(SHINGLE - len(w), np.uint64)]) if len(w) else w, min(len(w), 1)
        out = np.zeros(n, np.uint64)
        for k in range(SHINGLE if n else 0):
            out = mixed(out + w[k : k + n] + _ODD)
        return out


def labelled(sh: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Shingles made different by the number of equal ones before them in their text; first occurrences are even."""
    order = np.lexsort((sh, row))
    s, r = sh[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty_like(sh)
    one = np.uint64(1)
    out[order] = mixed(s + nth.astype(np.uint64) * _ODD) & ~one | (nth > 0).astype(np.uint64)
    return out


def tags(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The labelled shingles of each text, in text order."""
    if not texts:
        return []
    n = [len(t) for t in texts]
    return np.split(labelled(np.concatenate(texts), np.repeat(np.arange(len(n)), n)), np.cumsum(n)[:-1])


def sketches(texts: list[np.ndarray]) -> np.ndarray:
    """(texts, SKETCHES) sketch values, the sketch's number in the lowest bits; texts: labelled shingles of at least one each."""
    n = np.array([len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    row = np.repeat(np.arange(len(texts)), n)
    every = np.concatenate(texts)
    place = np.arange(len(every))
    out = np.empty((len(texts), SKETCHES), np.uint64)
    most = np.uint64(2**64 - 1)
    for i in range(SKETCHES):
        h = mixed(every ^ np.uint64((i + 1) * int(_A) % (1 << 64)))
        places = []
        for _ in range(KEPT):
            least = np.minimum.reduceat(h, first)
            at = np.minimum.reduceat(np.where(h == least[row], place, len(place)), first)
            places.append(at)
            h[at] = most
        value = np.full(len(texts), (i + 1) * int(_ODD) % (1 << 64), np.uint64)
        for at in np.sort(np.stack(places), axis=0):
            value = mixed(value + every[at])
        out[:, i] = value // np.uint64(SKETCHES) * np.uint64(SKETCHES) + np.uint64(i)
    return out


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Shingles of a and b matched in order, at most `band` places apart: the longest increasing chain of matching places."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b, a, side, sorter=order) for side in ("left", "right"))
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    # Places of b by falling order within one place of a, so that a chain takes one of them.
    j = order[np.repeat(high, n) - 1 - (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))]
    j = j[np.abs(i - j) <= band]
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return len(j)
    ends: list[int] = []
    for x in j.tolist():
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


def alike(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Shares of the labelled shingles of a and b that are matched: in order, of first occurrences anywhere, of all anywhere.

    A match in order is at most a ninth of both lengths apart, which is all that
    SIMILARITY leaves unmatched.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, 0.0, 0.0
    same = aligned(a, b, (n + m) // 9 + 1)
    if same / (n + m - same) >= SIMILARITY:
        return same / (n + m - same), 0.0, 0.0
    common = np.intersect1d(a, b, assume_unique=True)
    once = int((common % 2 == 0).sum())
    firsts = int((a % 2 == 0).sum() + (b % 2 == 0).sum())
    return same / (n + m - same), once / (firsts - once), len(common) / (n + m - len(common))


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(share of shingles aligned in order, share of the sets of shingles, 0 where the first is enough) of two texts."""
    x, y = tags([np.asarray(a).astype(np.uint64), np.asarray(b).astype(np.uint64)])
    return alike(x, y)[:2]


class Block:
    """Texts of one block: ids, classes, sketches and labelled shingles."""

    def __init__(self, texts: list[dict]):
        self.tid = [t["tid"] for t in texts]
        self.root = [t["root"] for t in texts]
        self.sketches = np.array([t["sketches"] for t in texts], np.int64).reshape(-1, SKETCHES)
        self.tags = [np.frombuffer(t["tags"], np.uint64) for t in texts]
        self.sizes = [np.array([len(t) for t in self.tags]), np.array([(t % 2 == 0).sum() for t in self.tags])]

    def some(self, keep: np.ndarray) -> Block:
        out = object.__new__(Block)
        for k in ("tid", "root", "tags"):
            setattr(out, k, [v for v, x in zip(getattr(self, k), keep.tolist(), strict=True) if x])
        out.sketches, out.sizes = self.sketches[keep], [x[keep] for x in self.sizes]
        return out


def shared(x: Block, y: Block) -> list[np.ndarray]:
    """For all pairs, the number of labelled shingles in both texts, and of first occurrences in both."""
    every = np.concatenate([*x.tags, *y.tags])
    owner = np.repeat(np.arange(len(x.tags) + len(y.tags)), [len(t) for t in (*x.tags, *y.tags)])
    values, column = np.unique(every, return_inverse=True)
    left = owner < len(x.tags)
    both = np.bincount(column[left], minlength=len(values)).astype(bool) & np.bincount(column[~left], minlength=len(values)).astype(bool)
    out = []
    for first in (True, False):
        wanted = both & ((values % 2 == 0) == first)
        place = np.where(wanted, np.cumsum(wanted) - 1, -1)[column]
        total = np.zeros((len(x.tags), len(y.tags)), np.float32)
        for start in range(0, int(wanted.sum()), COLUMNS):
            here = (place >= start) & (place < start + COLUMNS)
            matrix = np.zeros((len(x.tags) + len(y.tags), COLUMNS), np.float32)
            matrix[owner[here], place[here] - start] = 1
            total += matrix[: len(x.tags)] @ matrix[len(x.tags) :].T
        out.append(total)
    return [out[0] + out[1], out[0]]


def unite(x: Block, y: Block | None, k: int) -> list[tuple[bytes, bytes]]:
    """Links that join the classes of two blocks (or of one) as all their links do; k: the sketch of the bucket.

    Only pairs of two classes that share no sketch before k are looked at.
    """
    other = x if y is None else y
    number: dict[bytes, int] = {}
    rx, ry = (np.array([number.setdefault(r, len(number)) for r in s.root]) for s in (x, other))
    open_ = rx[:, None] != ry[None, :]
    if y is None:
        open_ &= np.triu(np.ones(open_.shape, bool), 1)
    for i in range(k):
        open_ &= x.sketches[:, i][:, None] != other.sketches[:, i][None, :]
    fit = np.zeros(open_.shape, bool)
    for n, m in zip(x.sizes, other.sizes, strict=True):
        fit |= np.minimum(n[:, None], m[None, :]) >= SIMILARITY * np.maximum(n[:, None], m[None, :])
    open_ &= fit
    if not open_.any():
        return []
    rows, columns = open_.any(axis=1), open_.any(axis=0)
    a, b, open_ = x.some(rows), other.some(columns), open_[np.ix_(rows, columns)]
    score = np.zeros(open_.shape)
    for common, n, m in zip(shared(a, b), a.sizes, b.sizes, strict=True):
        score = np.maximum(score, common / (n[:, None] + m[None, :] - common))
    i, j = np.nonzero(open_ & (score >= SIMILARITY - 1e-6))
    order = np.argsort(-score[i, j], kind="stable")
    joined = list(range(len(number)))

    def root(c: int) -> int:
        while joined[c] != c:
            joined[c] = c = joined[joined[c]]
        return c

    out = []
    ca, cb = rx[rows], ry[columns]
    for u, v in zip(i[order].tolist(), j[order].tolist(), strict=True):
        p, q = root(int(ca[u])), root(int(cb[v]))
        if p != q and max(alike(a.tags[u], b.tags[v])) >= SIMILARITY:
            joined[p] = q
            out.append((a.tid[u], b.tid[v]))
    return out


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        for i in range(batch.num_rows):
            other = batch.column("y")[i].as_py()
            found += unite(Block(batch.column("x")[i].as_py()), None if other is None else Block(other), batch.column("bucket")[i].as_py() % SKETCHES)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in slices(batches, most=1 << 20):
        texts = [shingler.shingles(t or "") for t in batch.column("text").to_pylist()]
        some = [i for i, t in enumerate(texts) if len(t)]
        values: list[list[int] | None] = [None] * len(texts)
        if some:
            for i, v in zip(some, sketches(tags([texts[i] for i in some])).view(np.int64).tolist(), strict=True):
                values[i] = v
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(values, pa.list_(pa.int64())), sizes], ["doc_id", "tid", "sketches", "n"])


def _tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in slices(batches, most=1 << 20):
        found = tags([shingler.shingles(t) for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array([t.tobytes() for t in found], pa.binary())], ["tid", "tags"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links among candidate pairs."""
    shingler, held = Shingler(), OrderedDict()

    def of(tid: bytes, text: str) -> np.ndarray:
        if tid not in held:
            held[tid] = tags([shingler.shingles(text)])[0]
            if len(held) > 16:
                held.popitem(last=False)
        held.move_to_end(tid)
        return held[tid]

    for batch in slices(batches, "text_a", 1 << 20):
        a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
        good = pa.array([max(alike(of(i, x), of(j, y))) >= SIMILARITY for i, j, x, y in zip(a, b, ta, tb, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])


def contract(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of the connected components of links (a, b): root is the least node.

    Large-star and small-star steps by turns, each a minimum of a node's
    neighbours and one join; a round is written to the shared folder. It ends when
    a round changes no edge: then the edges are the star of each component.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = edges.select("u", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = work.write(small.where("u <> v").distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _open(met: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame, work: Workspace) -> DataFrame:
    """(a, b): links that join all that is alike in the buckets of more than one class; met: (tid, bucket)."""
    classed = met.join(roots.withColumnRenamed("node", "tid").hint("merge"), "tid", "left").select("tid", "bucket", F.coalesce("root", "tid").alias("root"))
    classed = work.write(classed.join(nodes.hint("merge"), "tid"), "classed")
    several = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("texts"), F.sum("n").alias("n")).where("low <> high")
    several = several.select("bucket", F.ceil(F.greatest(F.col("texts") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    left = work.write(classed.join(several.hint("merge"), "bucket").drop("n"), "open")
    named = map_arrow(texts.join(left.select("tid").distinct().hint("merge"), "tid", "left_semi"), _tags, "tid binary, tags binary")
    # Blocks are drawn by hash: no sort of a whole bucket, and none in one task.
    left = left.withColumn("i", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")).join(named.hint("merge"), "tid")
    blocks = work.write(left.groupBy("bucket", "i", "blocks").agg(F.collect_list(F.struct("tid", "root", "sketches", "tags")).alias("x")), "blocks")
    own = blocks.select("bucket", "x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"))
    later = blocks.where("i > 0").select("bucket", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("i"), F.col("x").alias("y"))
    pairs = blocks.where("i < blocks - 1").select("bucket", "i", "x").join(later.hint("merge"), ["bucket", "i"]).select("bucket", "x", "y")
    return map_arrow(own.unionAll(pairs), _unite, "a binary, b binary")


def linked(docs: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of the classes of more than one text.

    docs: (tid, text) rows; nodes: one (tid, sketches, n) row for each text.
    """
    rows = nodes.select("tid", F.explode("sketches").alias("bucket"))
    shared = rows.groupBy("bucket").count().where("count > 1").select("bucket")
    rows = work.write(rows.join(shared.hint("merge"), "bucket"), "buckets")
    hubs = rows.groupBy("bucket").agg(F.min("tid").alias("hub"))
    met = work.write(rows.join(hubs.hint("merge"), "bucket"), "met")
    texts = work.write(docs.join(met.select("tid").distinct().hint("merge"), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text")), "texts")
    # Joined with the hub's text last, so that rows come by hubs and their shingles are made once.
    pairs = met.where("tid <> hub").select(F.col("tid").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = pairs.join(texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    pairs = pairs.join(texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    links = work.write(map_arrow(pairs, _check, "a binary, b binary"), "links")
    roots = contract(links, work)
    more = work.write(_open(met.drop("hub"), nodes, texts, roots, work), "more")
    return roots if more.isEmpty() else contract(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more), work)


def _roots(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, tid, root) of each document: root is the same for all texts of a class."""
    work = Workspace(docs.sparkSession, "near")
    rows = docs.select(dotted(id_column).alias("doc_id"), F.coalesce(dotted(text_column).cast("string"), F.lit("")).alias("text"), text_id(text_column).alias("tid"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketched = work.write(map_arrow(rows.select("doc_id", "tid", "text"), _sketch, f"doc_id {kind}, tid binary, sketches array<long>, n long"), "sketches")
    nodes = sketched.where(F.col("sketches").isNotNull()).groupBy("tid").agg(F.first("sketches").alias("sketches"), F.first("n").alias("n"))
    roots = linked(rows.select("tid", "text"), work.write(nodes, "nodes"), work)
    named = sketched.select("doc_id", "tid").join(roots.withColumnRenamed("node", "tid").hint("merge"), "tid", "left")
    return work.result(named.select("doc_id", "tid", F.coalesce("root", "tid").alias("root")))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The document of least id of each class, with all its columns; null ids come last, repeated rows count once."""
    named = _roots(docs, id_column, text_column)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("tid").alias("tid"))
    kept = named.groupBy("root").agg(F.min(order).alias("lead")).select(F.xxhash64("lead.doc_id").alias("key"), F.col("lead.tid").alias("tid"))
    row = F.xxhash64(*[F.to_json(dotted(f.name)) if "map<" in f.dataType.simpleString() else dotted(f.name) for f in docs.schema])
    rows = docs.select(F.struct(*[dotted(c).alias(c) for c in docs.columns]).alias("doc"), text_id(text_column).alias("tid"), dotted(id_column).alias("doc_id"), row.alias("row"))
    # Dealt by text and id, so that copies of one text are many tasks; what is left of it stays there to count once.
    found = rows.withColumn("key", F.xxhash64("doc_id")).join(kept.hint("merge"), ["key", "tid"], "left_semi")
    one = found.groupBy("key", "tid").agg(F.min_by("doc", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("doc"))
    return one.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, class_id, n_class) of each document."""
    named = _roots(docs, id_column, text_column)
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_class"))
    return named.join(least, "root").select("doc_id", "class_id", "n_class")
