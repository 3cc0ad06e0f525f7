"""Approximate nearest neighbours: vantage-point trees per shard.

Rows are dealt over shards, each of which becomes one tree: a node has a vantage point, halves its
rows by their distance to it, and keeps the least and the largest distance of both halves; leaves hold
rows side by side. By the triangle inequality no row of a half can be nearer to a query than the gap
between the query's own distance to the vantage point and that range. A half is passed over when this
bound, times ``factor``, lies above the query's k-th distance so far. Factor 1 only passes over rows
that can't be among the nearest: the search is exact. A larger factor prunes more and may lose some.

Queries are dealt over blocks. A task searches a group of trees one after the other with one block, so
that a query brings its k-th distance from one tree into the next, and returns k rows for each query.
In a tree each query first scans the leaf it falls into, then the others by the bounds, all queries of
the block that need a node together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import grouped, runs, small_batches, staged


@dataclass(frozen=True)
class Search:
    """k: neighbours of a query. factor: 1 is exact, more prunes more. shard_rows, leaf_rows, block_rows: rows of a tree, a leaf, a block of queries. trees: searched by one task."""

    k: int = 10
    factor: float = 1.0
    shard_rows: int = 4096
    leaf_rows: int = 256
    block_rows: int = 4096
    trees: int = 4
    seed: int = 11


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, the squares added in the order of the components."""
    total = np.zeros(max(len(a), len(b)))
    for j in range(a.shape[1]):
        off = a[:, j] - b[:, j]
        total += off * off
    return np.sqrt(total)


class Tree:
    """nodes: (start, end, left, right), left -1 in a leaf. points: vantage points. ranges: (least, largest) distance of the left and of the right half."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray, points: np.ndarray, ranges: np.ndarray):
        self.ids, self.x, self.nodes, self.points, self.ranges = ids, x, nodes, points, ranges
        self.norms = np.einsum("nd,nd->n", x, x)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, leaf_rows: int, seed: int) -> Tree:
        rng = np.random.default_rng(seed)
        order = np.arange(len(x))
        nodes, points, ranges, todo = [[0, len(x), -1, -1]], [np.zeros(x.shape[1])], [[0.0] * 4], [0]
        while todo:
            n = todo.pop()
            start, end = nodes[n][:2]
            if end - start <= leaf_rows:
                continue
            own = order[start:end]
            some = x[rng.choice(own, min(32, len(own)), replace=False)]
            # of a few, the point whose distances differ most
            point = max((x[p] for p in rng.choice(own, 4)), key=lambda p: np.nan_to_num(distance(some, p[None]).std()))
            far = distance(x[own], point[None])
            by = np.argsort(far, kind="stable")
            order[start:end], far, half = own[by], far[by], len(own) // 2
            nodes[n][2:] = [len(nodes), len(nodes) + 1]
            points[n], ranges[n] = point, [far[0], far[half - 1], far[half], far[-1]]
            for a, b in ((start, start + half), (start + half, end)):
                todo.append(len(nodes))
                nodes.append([a, b, -1, -1])
                points.append(np.zeros(x.shape[1]))
                ranges.append([0.0] * 4)
        return cls(ids[order], x[order], np.array(nodes), np.array(points), np.array(ranges))

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf each query falls into."""
        at = np.zeros(len(q), np.int64)
        while True:
            inner = np.flatnonzero(self.nodes[at, 2] >= 0)
            if not len(inner):
                return at
            n = at[inner]
            far = distance(q[inner], self.points[n])
            at[inner] = np.where(far <= self.ranges[n, 1], self.nodes[n, 2], self.nodes[n, 3])


class Nearest:
    """The k nearest so far of a block of queries; equal distances by id."""

    def __init__(self, q: np.ndarray, own: np.ndarray, opts: Search):
        self.q, self.own, self.opts = q, own, opts
        self.norms = np.einsum("nd,nd->n", q, q)
        self.score = np.full((len(q), opts.k), np.inf)
        self.ids = np.full((len(q), opts.k), np.iinfo(np.int64).max)
        self.found = np.zeros(len(q), np.int64)
        self.scanned = 0

    def scan(self, tree: Tree, leaf: int, rows: np.ndarray) -> None:
        start, end = tree.nodes[leaf, :2]
        x, ids, k = tree.x[start:end], tree.ids[start:end], self.opts.k
        self.scanned += len(rows) * len(x)
        with np.errstate(all="ignore"):
            near = self.norms[rows, None] + tree.norms[start:end] - 2 * (self.q[rows] @ x.T)
            other = ids != self.own[rows, None]
            slack = 1e-9 * (self.norms[rows] + tree.norms[start:end].max())
            most = self.score[rows, -1] ** 2
            if end - start > k:
                most = np.minimum(most, np.partition(np.where(other, near, np.inf), k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero(other & ~(near > (most + slack)[:, None]))  # what overflowed stays
        if not len(r):
            return
        score = np.concatenate([distance(self.q[rows[r[i : i + 65536]]], x[c[i : i + 65536]]) for i in range(0, len(r), 65536)])
        some = np.unique(r)
        place = np.concatenate([np.repeat(some, k), r])
        score = np.concatenate([self.score[rows[some]].ravel(), score])
        ids = np.concatenate([self.ids[rows[some]].ravel(), ids[c]])
        new = np.concatenate([np.arange(len(some) * k) % k < np.repeat(self.found[rows[some]], k), np.ones(len(r), bool)])
        order = np.lexsort((ids, score, ~new, place))
        first = np.searchsorted(place[order], some)
        best = order[first[:, None] + np.arange(k)]
        self.score[rows[some]], self.ids[rows[some]] = score[best], ids[best]
        self.found[rows[some]] = new[best].sum(axis=1)

    def search(self, tree: Tree) -> None:
        home = tree.home(self.q)
        order = np.argsort(home, kind="stable")
        for lo, hi in runs(home[order]):
            self.scan(tree, int(home[order[lo]]), order[lo:hi])
        todo = [(0, np.arange(len(self.q)), np.zeros(len(self.q)))]
        while todo:
            node, rows, low = todo.pop()
            with np.errstate(invalid="ignore"):
                kept = ~(low * self.opts.factor > self.score[rows, -1])
            rows, low = rows[kept], low[kept]
            left, right = tree.nodes[node, 2:]
            if left < 0:
                rows = rows[home[rows] != node]
                if len(rows):
                    self.scan(tree, node, rows)
            elif len(rows):
                far = distance(self.q[rows], tree.points[node][None])
                with np.errstate(invalid="ignore"):
                    for child, (least, most) in ((right, tree.ranges[node, 2:]), (left, tree.ranges[node, :2])):
                        gap = np.maximum(least - far, far - most) - 1e-9 * (far + most)  # for rounding
                        todo.append((int(child), rows, np.fmax(low, gap)))


_DOUBLES, _LONGS = pa.list_(pa.float64()), pa.list_(pa.int64())
_TREE = pa.schema([("key", pa.int64()), ("ids", _LONGS), ("x", _DOUBLES), ("nodes", _LONGS), ("points", _DOUBLES), ("ranges", _DOUBLES)])
_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _build(opts: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in grouped(batches, "key"):
            keys = some.column("key").to_numpy()
            for lo, hi in runs(keys):
                part = some.slice(lo, hi - lo)
                x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                tree = Tree.build(part.column("id").to_numpy(), x, opts.leaf_rows, opts.seed)
                row = [keys[lo], tree.ids, tree.x.ravel(), tree.nodes.ravel(), tree.points.ravel(), tree.ranges.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TREE.types, strict=True)], schema=_TREE)

    return run


def _tree(row: dict) -> Tree:
    ids, x, nodes, points, ranges = (row[c].values.to_numpy() for c in ("ids", "x", "nodes", "points", "ranges"))
    return Tree(ids, x.reshape(len(ids), -1), nodes.reshape(-1, 4), points.reshape(-1, x.size // len(ids)), ranges.reshape(-1, 4))


def _search(opts: Search):
    """Rows of one (block, group) stand together: its queries, then its trees."""

    def result(queries: list, nearest: Nearest | None) -> pa.RecordBatch:
        row, k = np.nonzero(np.arange(opts.k) < nearest.found[:, None]) if nearest else (np.empty(0, np.int64),) * 2
        names, ids = (np.array(x, np.int64) for x in zip(*queries, strict=True)) if queries else (np.empty(0, np.int64),) * 2
        score, found = (nearest.score[row, k], nearest.ids[row, k]) if nearest else (np.empty(0), row)
        return pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids[row]), pa.array(found), pa.array(score)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, vectors, nearest = None, [], [], None
        for batch in batches:
            for k, key in enumerate(batch.column("task").to_pylist()):
                if key != now:
                    yield result(queries, nearest)
                    now, queries, vectors, nearest = key, [], [], None
                if batch.column("kind")[k].as_py() == 0:
                    queries.append((batch.column("query")[k].as_py(), batch.column("query_id")[k].as_py()))
                    vectors.append(batch.column("v")[k].values.to_numpy())
                elif queries:
                    nearest = nearest or Nearest(np.stack(vectors), np.array([i for _, i in queries], np.int64), opts)
                    nearest.search(_tree(batch.column("tree")[k]))
        yield result(queries, nearest)

    return run


def nearest_neighbours(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", opts: Search = Search()) -> DataFrame:
    """The k nearest rows of each row for which ``queries`` (a condition on the id, as column ``id``) holds: query_id, rank, vec_id, score.

    Nearness is Euclidean distance in double precision, ties go to the smaller id. Every usable row is
    a candidate, but not for queries of its own id; fewer than k give fewer rows. A row takes no part
    without an id, or if its vector is null, empty, zero or holds a null or non-finite component.
    Vectors of other lengths never meet. Repeated rows are queries and candidates each.
    An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL").where(fine)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    wanted = F.coalesce(queries, F.lit(False))
    sizes = rows.groupBy(F.size("v").alias("of")).agg(F.count("*").alias("n"), F.count_if(wanted).alias("q"))
    sizes = sizes.select("of", F.ceil(F.col("n") / opts.shard_rows).cast("long").alias("shards"), F.ceil(F.col("q") / opts.block_rows).cast("long").alias("blocks"))
    sizes = F.broadcast(staged(sizes.withColumn("groups", F.ceil(F.col("shards") / opts.trees).cast("long")), "lengths"))
    rows = rows.withColumn("of", F.size("v")).join(sizes, "of")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard = F.col("of") * F.lit(1 << 36) + F.pmod(F.xxhash64("row"), F.col("shards"))
    dealt = rows.where("blocks > 0").select(shard.alias("key"), "id", "v").repartition(parts, "key").sortWithinPartitions("key")
    trees = staged(dealt.mapInArrow(_build(opts), "key long, ids array<long>, x array<double>, nodes array<long>, points array<double>, ranges array<double>"), "trees")
    trees = trees.withColumn("of", F.expr(f"cast(key div {1 << 36} as int)")).join(sizes, "of")
    task = F.struct("of", "block", "group").alias("task")
    none = F.lit(None)
    tree = F.struct("ids", "x", "nodes", "points", "ranges").alias("tree")
    trees = trees.withColumn("group", F.expr(f"key % {1 << 36}") % F.col("groups")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    trees = trees.select(task, F.lit(1).alias("kind"), none.cast("long").alias("query"), none.cast("long").alias("query_id"), none.cast("array<double>").alias("v"), tree)
    asked = rows.where(wanted).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.col("blocks"))).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    asked = asked.select(task, F.lit(0).alias("kind"), F.col("row").alias("query"), F.col("id").alias("query_id"), "v", none.cast(trees.schema["tree"].dataType).alias("tree"))
    both = asked.unionByName(trees)
    found = both.repartition(parts, "task").sortWithinPartitions("task", "kind", "query").mapInArrow(_search(opts), "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy("score", "vec_id")  # k rows of each group of trees
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= opts.k)
    return found.select("query_id", "rank", "vec_id", "score")
