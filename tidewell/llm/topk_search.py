"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers. A few pivots from a bounded sample cut all vectors into
cells, by the nearest pivot; queries and candidates of a cell are dealt into blocks
of bounded size, and each block becomes one cover tree. Two nodes of centres q, p
and covering radii r, s have no product above q.p + r|p| + s|q| + rs, nor above the
product of their largest norms, so a pair of nodes whose bound is below the worst
kth score of the query node's queries is left out.

The cells are the top of the tree. First each query block meets the candidates of
its own cell, which gives a threshold for each query. Then those cells follow whose
bound beats the worst threshold of a query cell, nearest cells first. A task holds
one query tree and lets the candidate trees of a lane pass by, one at a time, so
that thresholds rise from block to block and a query gives k hits for each lane,
however many blocks there are. The best k of all lanes are then ranked by Spark.

Defined results: vectors that are null or empty or hold a null or non-finite
component take no part, nor do rows of null id; ids of any type that can be ordered;
a shorter vector counts as if zeros followed; repeated rows of a candidate are
listed each, and rows that share the query's id are never its candidates; equal
scores go to the smaller id; an empty table gives an empty table; columns other
than the id and the vector are neither read nor returned.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import Workspace, dotted, map_arrow

K = 20
QUERY_EVERY = 20
#: Rows of a block of candidates and of queries.
BLOCK, QUERY_BLOCK = 2048, 256
#: Cells at most, and rows of the sample for each pivot that it may give.
PIVOTS, SAMPLE = 64, 16
#: Parts into which the candidate blocks of a query block are dealt.
LANES = 8
#: Points of a leaf and children of a node at most; radius of the children over that of their parent.
LEAF, FANOUT, STEP = 256, 16, 0.6
#: A node of more than FEW points is cut by centres where that leaves the points this share of their mean distance.
FEW, NEARER = 4, 0.5


def quantise(column: str = "embedding", factor: int = 64):
    """floor(factor * x) of each component."""
    return F.transform(column, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def usable(column: str = "embedding"):
    """Vectors whose components are all finite numbers; false for null."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine & (F.size(column) > 0), F.lit(False))


class CoverTree:
    """Nodes in arrays; each covers a range of the reordered points. Node 0 is the root."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, floor: np.ndarray | None = None):
        """floor: scores that hits of each point must reach at least."""
        order: list[np.ndarray] = []
        self.centre, self.radius, self.kids, self.range = [], [], [], []
        x = points.astype(float)
        at = 0
        # (points, centre, index of the node); children are made in depth-first order.
        self._new()
        todo = [(np.arange(len(points)), 0, 0)]
        while todo:
            own, centre, node = todo.pop()
            far = np.sqrt(((x[own] - x[centre]) ** 2).sum(axis=1))
            self.centre[node], self.radius[node] = x[centre], float(far.max())
            groups = self._cover(x, own, centre, far) if len(own) > FEW and far.max() > 0 else None
            if groups is None:
                order.append(own)
                self.range[node] = (at, at + len(own))
                at += len(own)
                continue
            for c, members in groups:
                self.kids[node].append(child := self._new())
                todo.append((members, c, child))
        at_order = np.concatenate(order) if order else np.zeros(0, int)
        self.ids, self.points = ids[at_order], points[at_order]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor[at_order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        #: The points below each node stand together: children follow their parents, the last one first.
        self.span = list(self.range)
        for node in range(len(self.kids) - 1, -1, -1):
            if self.kids[node]:
                self.span[node] = (min(self.span[c][0] for c in self.kids[node]), max(self.span[c][1] for c in self.kids[node]))

    def _new(self) -> int:
        self.centre.append(None)
        self.radius.append(0.0)
        self.kids.append([])
        self.range.append((0, 0))
        return len(self.kids) - 1

    @staticmethod
    def _cover(x: np.ndarray, own: np.ndarray, centre: int, far: np.ndarray) -> list[tuple[int, np.ndarray]] | None:
        """Centres farther apart than the children's radius, FANOUT at most, each with the points nearest to it.

        Where points come no nearer to their centres by that, LEAF or fewer stay
        together (None) and more are cut across, into parts of LEAF at most.
        """
        reach = STEP * far.max()
        nearest, best, centres = np.zeros(len(own), int), far.copy(), [centre]
        while len(centres) < FANOUT and best[k := int(best.argmax())] > reach:
            d = np.sqrt(((x[own] - x[own[k]]) ** 2).sum(axis=1))
            closer = d < best
            nearest[closer], best[closer] = len(centres), d[closer]
            centres.append(int(own[k]))
        if best.mean() > NEARER * far.mean():
            if len(own) <= LEAF:
                return None
            parts = np.array_split(own[np.argsort(x[own] @ (x[own[int(far.argmax())]] - x[centre]), kind="stable")], -(-len(own) // LEAF))
            return [(int(part[((x[part] - x[part].mean(axis=0)) ** 2).sum(axis=1).argmin()]), part) for part in parts]
        groups = [(c, own[nearest == i]) for i, c in enumerate(centres)]
        return [(c, m) for c, m in groups if len(m)]


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their products are exact."""
    most = (int(np.abs(a).max(initial=0)) or 1) * (int(np.abs(b).max(initial=0)) or 1) * max(1, a.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return a.astype(kind), b.astype(kind)


class Search:
    """The k best candidates of each query of a tree, over any number of candidate trees."""

    def __init__(self, queries: CoverTree, k: int):
        self.queries, self.k, self.products = queries, k, 0
        n = len(queries.points)
        self.best = np.full((n, k), -np.inf)
        #: The score that a hit must reach: the floor, or the kth best so far.
        self.least = queries.floor.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def meet(self, data: CoverTree) -> None:
        """Search one more candidate tree."""
        width = max(self.queries.points.shape[1], data.points.shape[1])
        wide = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
        q, p = _exact(wide(self.queries.points), wide(data.points))
        qc, pc = wide(self.queries.centre), wide(data.centre)
        todo = [(0, [0])]
        while todo:
            a, nodes = todo.pop()
            nodes = [b for b, t in zip(nodes, self._bounds(a, nodes, qc, pc, data), strict=True) if t >= self._worst(a)]
            if self.queries.kids[a]:
                # Candidate nodes wider than the query node are opened before the query node is.
                opened: list[int] = []
                for b in nodes:
                    opened.extend(data.kids[b] if data.kids[b] and data.radius[b] > self.queries.radius[a] else [b])
                todo.extend((c, opened) for c in self.queries.kids[a])
                continue
            heap = [(-t, b) for t, b in zip(self._bounds(a, nodes, qc, pc, data).tolist(), nodes, strict=True)]
            heapq.heapify(heap)
            # Leaves are met in order of their bounds, each time twice as many at once.
            leaves, at_once = [], 1
            while heap:
                t, b = heapq.heappop(heap)
                if -t < self._worst(a):
                    break
                if data.kids[b]:
                    for x, c in zip(self._bounds(a, data.kids[b], qc, pc, data).tolist(), data.kids[b], strict=True):
                        heapq.heappush(heap, (-x, c))
                    continue
                leaves.append(data.range[b])
                if len(leaves) == at_once:
                    self._leaves(self.queries.range[a], leaves, q, p, data)
                    leaves, at_once = [], 2 * at_once
            if leaves:
                self._leaves(self.queries.range[a], leaves, q, p, data)

    def _bounds(self, a: int, nodes: list[int], qc: np.ndarray, pc: np.ndarray, data: CoverTree) -> np.ndarray:
        b, x = np.asarray(nodes, int), self.queries
        r, s = x.radius[a], data.radius[b]
        top = np.minimum(pc[b] @ qc[a] + r * data.norm[b] + s * x.norm[a] + r * s, (x.norm[a] + r) * (data.norm[b] + s))
        return top + 1e-6 * (1 + np.abs(top))

    def _worst(self, a: int) -> float:
        i, j = self.queries.span[a]
        return float(self.least[i:j].min())

    def _leaves(self, own: tuple[int, int], others: list[tuple[int, int]], q: np.ndarray, p: np.ndarray, data: CoverTree) -> None:
        """All products of a query leaf and some candidate leaves."""
        i, j = own
        at = np.concatenate([np.arange(u, v) for u, v in others])
        s = q[i:j] @ p[at].T
        self.products += s.size
        ids = data.ids[at]
        worth = (s >= self.least[i:j, None]) & (self.queries.ids[i:j, None] != ids[None, :])
        rows = np.flatnonzero(worth.any(axis=1))
        if not len(rows):
            return
        r, c = np.nonzero(worth)
        self.found.append((r + i, ids[c], s[r, c]))
        both = np.concatenate([self.best[rows + i], np.where(worth[rows], s[rows], -np.inf).astype(float)], axis=1)
        top = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
        self.best[rows + i] = top
        self.least[rows + i] = np.maximum(self.least[rows + i], top.min(axis=1))
        self.held += len(r)
        if self.held > 4 * self.k * len(q) + 4096:
            self._thin()

    def _thin(self) -> None:
        """Only the k best of each query are held; of equal scores, the smaller ids."""
        if not self.found:
            return
        rows, ids, scores = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        keep = scores >= self.least[rows]
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        self.found = [(rows[top], ids[top], scores[top])]
        self.held = int(top.sum())

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, candidate id, score) of the k best of each query."""
        self._thin()
        if not self.found:
            return self.queries.ids[:0], self.queries.ids[:0], np.zeros(0, np.int64)
        rows, ids, scores = self.found[0]
        return self.queries.ids[rows], ids, scores.astype(np.int64)


def _points(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of equal width."""
    vectors = column.to_pylist()
    points = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        points[i, : len(v)] = v
    return points


def _ids(column) -> np.ndarray:
    values = column.to_pylist()
    return np.array(values) if values else np.zeros(0, np.int64)


def _assign(pivots: list[list[int]]):
    """The nearest pivot of each vector, its distance and the vector's norm; of equal distances the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _points(batch.column("v")).astype(float)
            width = max(x.shape[1], max(map(len, pivots)))
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
            far = np.stack([np.sqrt(((x - np.pad(np.array(p, float), (0, width - len(p)))) ** 2).sum(axis=1)) for p in pivots], axis=1)
            cell = far.argmin(axis=1)
            more = [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), pa.array(np.sqrt((x**2).sum(axis=1)))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *more], ["vec_id", "v", "cell", "far", "norm"])

    return run


def _tree(table: pa.Table) -> pa.Table:
    floor = np.array([-np.inf if f is None else f for f in table.column("floor").to_pylist()]) if "floor" in table.column_names else None
    tree = CoverTree(_ids(table.column("vec_id")), _points(table.column("v")), floor)
    return pa.table({"cell": table.column("cell")[:1], "block": table.column("block")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _pass(k: int, kind: pa.DataType):
    """Hits of rows sorted by query block and lane: a query tree first, its candidate trees after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            for i in range(batch.num_rows):
                tree = pickle.loads(batch.column("tree")[i].as_py())
                if batch.column("place")[i].as_py() >= 0:
                    search.meet(tree)
                    continue
                if search is not None:
                    yield out(search)
                search = Search(tree, k)
        if search is not None:
            yield out(search)

    def out(search: Search) -> pa.RecordBatch:
        query, ids, scores = search.hits()
        return pa.RecordBatch.from_arrays([pa.array(query.tolist(), kind), pa.array(ids.tolist(), kind), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


def pivots_of(rows: DataFrame, n: int) -> list[list[int]]:
    """n vectors far from each other, out of the SAMPLE * n vectors of the least hash of their id."""
    some = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE * n).select("v").collect()]
    width = max(map(len, some), default=0)
    x = np.array([[*v, *[0] * (width - len(v))] for v in some], float).reshape(len(some), width)
    chosen, far = [0], np.sqrt(((x - x[:1]) ** 2).sum(axis=1)) if some else np.zeros(0)
    while some and len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
    return [some[i] for i in chosen] if some else []


def top_k(vectors: DataFrame, is_query, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    is_query: a condition on the id that states the query set. Where nothing can be
    left out, all candidates pass by each query block, once.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "top-k")
    rows = vectors.select(dotted(id_column).alias("vec_id"), dotted(vector_column).alias("embedding")).where(F.col("vec_id").isNotNull() & usable())
    rows = work.write(rows.select("vec_id", quantise().alias("v")), "vectors")
    kind = rows.schema["vec_id"].dataType
    n_queries = rows.where(is_query(F.col("vec_id"))).count()
    pivots = pivots_of(rows, max(1, min(PIVOTS, -(-n_queries // query_block))))
    hits_schema = f"query_id {kind.simpleString()}, vec_id {kind.simpleString()}, score long"
    if not n_queries:
        return _ranked(spark.createDataFrame([], hits_schema), k)
    rows = work.write(map_arrow(rows, _assign(pivots), f"vec_id {kind.simpleString()}, v array<long>, cell int, far double, norm double"), "cells")
    queries = rows.where(is_query(F.col("vec_id")))

    # One row for each cell, PIVOTS at most, comes to the driver.
    measured = lambda df: {r["cell"]: r for r in df.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}
    data_cells, query_cells = measured(rows), measured(queries)

    def trees(df: DataFrame, cells: dict, size: int) -> DataFrame:
        blocks = F.lit(1)
        for c, r in cells.items():
            blocks = F.when(F.col("cell") == c, F.lit(-(-r["n"] // size))).otherwise(blocks)
        # Rows are dealt by a hash of the whole row's place, so repeated ids spread too.
        dealt = df.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), blocks).cast("int")).drop("far", "norm")
        return dealt.groupBy("cell", "block").applyInArrow(_tree, "cell int, block int, tree binary")

    data = work.write(trees(rows, data_cells, block), "trees")

    def met(query_trees: DataFrame, allowed: list[tuple[int, int, int]], lanes: int) -> DataFrame:
        """Hits of query cells in candidate cells, in order of place; allowed: (query cell, cell, place)."""
        pairs = spark.createDataFrame(allowed, "q int, cell int, place int")
        asked = query_trees.withColumnRenamed("cell", "q").withColumnRenamed("block", "a").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("place", F.lit(-1))
        named = query_trees.select(F.col("cell").alias("q"), F.col("block").alias("a")).join(F.broadcast(pairs), "q")
        given = data.withColumn("lane", F.pmod(F.xxhash64("cell", "block"), F.lit(lanes)).cast("int")).join(named.hint("merge"), "cell")
        columns = ["q", "a", "lane", "place", "tree"]
        stream = asked.select(*columns).unionAll(given.select(*columns)).repartition("q", "a", "lane").sortWithinPartitions("q", "a", "lane", "place")
        return work.write(map_arrow(stream.select("place", "tree"), _pass(k, to_arrow_type(kind)), hits_schema), "hits")

    first = met(work.write(trees(queries, query_cells, query_block), "queries"), [(c, c, 0) for c in query_cells], 1)
    floors = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    queries = work.write(queries.join(floors.hint("merge"), "vec_id", "left"), "floors")
    # A query without k hits yet has no floor, and its cell none either.
    worst = {r["cell"]: r["worst"] for r in queries.groupBy("cell").agg(F.when(F.count("floor") == F.count("*"), F.min("floor")).alias("worst")).collect()}
    far = lambda a, b: float(np.sqrt(sum((x - y) ** 2 for x, y in zip_longest(pivots[a], pivots[b], fillvalue=0))))
    allowed = []
    for a, q in query_cells.items():
        others = sorted((far(a, b), b) for b in data_cells if b != a)
        allowed += [(a, b, place) for place, (_, b) in enumerate(others) if worst[a] is None or _cell_bound(pivots[a], q, pivots[b], data_cells[b]) >= worst[a]]
    hits = first.unionAll(met(work.write(trees(queries, query_cells, query_block), "queries"), allowed, LANES)) if allowed else first
    return work.result(_ranked(hits, k))


def _cell_bound(q: list[int], of_q, p: list[int], of_p) -> float:
    """No product of a query of one cell and a candidate of another is larger."""
    product = sum(x * y for x, y in zip(q, p, strict=False))
    size = lambda v: float(np.sqrt(sum(x * x for x in v)))
    top = min(product + of_q["far"] * size(p) + of_p["far"] * size(q) + of_q["far"] * of_p["far"], of_q["norm"] * of_p["norm"])
    return top + 1e-6 * (1 + abs(top))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
