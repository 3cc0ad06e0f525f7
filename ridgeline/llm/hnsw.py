"""Embedding near-dedup with a hierarchical navigable small-world graph per shard.

Vectors link when they share a label and their cosine is at least a threshold. Equal vectors of a
label become one representative with its number of copies; representatives are dealt over shards of
bounded size within their label, and each shard becomes one graph: exact small upper layers, and a
bottom layer to which nodes are added in batches, each linked to diverse neighbours found by a beam
search and within its batch. Every shard of a label is then searched with every other's vectors (one
task per pair of shards). A query whose beam ends above the threshold gets a wider one; so do all if
an audit of sampled queries against an exact scan finds a lost link. A search begins with the graph
unless the shard has no more vectors than the beam; a beam that widening takes to a quarter of the
shard becomes the exact scan, which is cheaper then and loses nothing. Links are verified in double precision; a task returns, per vector, the number of links,
and a spanning forest of them, never the list of pairs.

Searching every shard is quadratic in the number of shards of one label; ``shard_rows`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Forest, components, grouped, join_skewed, runs, small_batches, staged


@dataclass(frozen=True)
class Graph:
    """threshold: least cosine of a link. beam, links, most: width of a search, links made by a new node, links kept."""

    threshold: float = 0.98
    shard_rows: int = 16384
    beam: int = 48
    links: int = 12
    most: int = 32
    audited: int = 64
    seed: int = 7


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def diverse(x: np.ndarray, base: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Per row: up to keep of the candidate ids (-1: none), nearest first, passing over one nearer to a kept one than to the base; then the nearest passed over."""
    sims = np.einsum("bkd,bd->bk", x[ids], base)
    sims[ids < 0] = -9
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    own = x[ids]
    among = own @ own.transpose(0, 2, 1)
    n, k = ids.shape
    kept = np.zeros((n, k), bool)
    for j in range(k):
        near = (np.where(kept, among[:, j, :], -9) > sims[:, j, None]).any(axis=1)
        kept[:, j] = ~near & (sims[:, j] > -9) & (kept.sum(axis=1) < keep)
    rank = np.where(sims > -9, np.where(kept, 0, 1), 2)
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    return np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)


class Hnsw:
    """Graph over the rows of x (unit vectors)."""

    def __init__(self, x: np.ndarray, opts: Graph):
        self.x, self.opts = np.ascontiguousarray(x, np.float32), opts
        n = len(x)
        order = np.random.default_rng(opts.seed).permutation(n)
        sizes = [n]
        while sizes[-1] > 64:
            sizes.append(max(48, sizes[-1] // 16))
        self.layers = [(order[:s], self._exact(order[:s])) for s in sizes[:0:-1]]  # the top one first
        core = order[: sizes[1]] if len(sizes) > 1 else order
        self.bottom = np.full((n, opts.most), -1, np.int32)
        links = self._exact(core)
        self.bottom[core, : links.shape[1]] = np.where(links >= 0, core[links], -1)
        at = len(core)
        while at < n:
            batch = order[at : at + min(at, 1024)]
            self._insert(batch)
            at += len(batch)

    def _exact(self, nodes: np.ndarray) -> np.ndarray:
        """Links among a small set of nodes, by their places in it."""
        x, out = self.x[nodes], []
        k = min(len(nodes) - 1, 2 * self.opts.most)
        if k < 1:
            return np.full((len(nodes), 1), -1)
        for lo in range(0, len(nodes), 256):
            sims = x[lo : lo + 256] @ x.T
            sims[np.arange(len(sims)), lo + np.arange(len(sims))] = -9
            out.append(diverse(x, x[lo : lo + 256], np.argpartition(-sims, k - 1, axis=1)[:, :k], self.opts.most))
        return np.concatenate(out)

    def _insert(self, batch: np.ndarray) -> None:
        opts, x = self.opts, self.x[batch]
        found = np.concatenate([self.beam(x[lo : lo + 512], opts.beam)[0] for lo in range(0, len(batch), 512)])
        sims = x @ x.T
        np.fill_diagonal(sims, -9)
        k = min(len(batch) - 1, 16)
        near = batch[np.argpartition(-sims, k - 1, axis=1)[:, :k]] if k > 0 else np.empty((len(batch), 0), np.int64)
        cand = np.concatenate([found, near], axis=1)
        links = np.concatenate([diverse(self.x, x[lo : lo + 256], cand[lo : lo + 256], opts.links) for lo in range(0, len(batch), 256)])
        self.bottom[batch, : links.shape[1]] = links
        source, target = np.repeat(batch, links.shape[1]), links.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 512):
            own, f, c = nodes[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
            width = min(int(c.max()), 2 * opts.most)
            place = np.arange(width)
            more = np.where(place < c[:, None], source[np.minimum(f[:, None] + place, len(source) - 1)], -1)
            have = self.bottom[own]
            more = np.where((more[:, :, None] == have[:, None, :]).any(axis=2), -1, more)
            both = np.concatenate([have, more], axis=1)
            full = (both >= 0).sum(axis=1) > opts.most
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : opts.most]
            if full.any():
                packed[full] = diverse(self.x, self.x[own[full]], both[full], opts.most)
            self.bottom[own] = packed

    def _enter(self, q: np.ndarray) -> np.ndarray:
        """A node near each query, by greedy steps down the upper layers."""
        at = None
        for nodes, links in self.layers:
            place = np.zeros(len(q), np.int64) if at is None else np.searchsorted(self._sorted(nodes)[0], at)
            place = place if at is None else self._sorted(nodes)[1][place]
            best = np.einsum("qd,qd->q", self.x[nodes[place]], q)
            while True:
                near = links[place]
                sims = np.where(near >= 0, np.einsum("qkd,qd->qk", self.x[nodes[near]], q), -9)
                k = sims.argmax(axis=1)
                top = sims[np.arange(len(q)), k]
                better = top > best
                if not better.any():
                    break
                place = np.where(better, near[np.arange(len(q)), k], place)
                best = np.maximum(best, top)
            at = nodes[place]
        return np.zeros(len(q), np.int64) if at is None else at

    @staticmethod
    def _sorted(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(nodes)
        return nodes[order], order

    def beam(self, q: np.ndarray, width: int, steps_at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of about the nearest ``width`` nodes of each query, in no order; -1 where there are none."""
        n, rows = len(self.x), np.arange(len(q))
        q = q.astype(np.float32)
        start = self._enter(q) if self.layers else np.full(len(q), self._first, np.int64)
        width = min(width, n)
        ids, sims = np.full((len(q), width), -1, np.int64), np.full((len(q), width), -9, np.float32)
        ids[:, 0], sims[:, 0] = start, np.einsum("qd,qd->q", self.x[start], q)
        done = np.zeros((len(q), width), bool)
        mark = np.zeros((len(q), n), np.int32)
        mark[rows, start] = 1
        stamp, live, e = 1, rows, min(steps_at_once, width)
        while len(live):
            open_sims = np.where(done[live], -9, sims[live])
            pick = np.argpartition(-open_sims, e - 1, axis=1)[:, :e]
            value = np.take_along_axis(open_sims, pick, 1)
            some = value.max(axis=1) > -9
            live, pick, value = live[some], pick[some], value[some]
            if not len(live):
                break
            nodes = np.where(value > -9, ids[live[:, None], pick], -1)
            done[live[:, None], pick] = True
            near = np.where(nodes[:, :, None] >= 0, self.bottom[nodes], -1).reshape(len(live), -1).astype(np.int64)
            r = np.broadcast_to(live[:, None], near.shape)
            fresh = (near >= 0) & (mark[r, near] == 0)
            column = np.broadcast_to(np.arange(near.shape[1]) + stamp + 1, near.shape)
            mark[r[fresh], near[fresh]] = column[fresh]
            fresh &= mark[r, near] == column  # once, where two lists hold it
            stamp += near.shape[1] + 1
            new = np.where(fresh, np.einsum("qkd,qd->qk", self.x[near], q[live]), -9)
            ids_all = np.concatenate([ids[live], near], axis=1)
            sims_all = np.concatenate([sims[live], new], axis=1)
            done_all = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(-sims_all, width - 1, axis=1)[:, :width]
            ids[live], sims[live], done[live] = (np.take_along_axis(a, top, 1) for a in (ids_all, sims_all, done_all))
        return np.where(sims > -9, ids, -1), sims

    @property
    def _first(self) -> int:
        return int(np.random.default_rng(self.opts.seed).permutation(len(self.x))[0])


def range_search(graph: Hnsw, exact: np.ndarray, q: np.ndarray, opts: Graph) -> tuple[np.ndarray, np.ndarray, dict]:
    """(query, node) of all links found, verified; and what the audit saw. exact: the graph's unit vectors in double."""
    n, floor = len(exact), opts.threshold - 1e-4  # the graph's vectors are in single precision

    def scans(width: int) -> bool:
        return width >= n or width > opts.beam and 4 * width >= n

    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    rng = np.random.default_rng(opts.seed)
    audit = np.sort(rng.choice(len(q), min(opts.audited, len(q)), replace=False))
    truth = {int(i): np.flatnonzero(exact @ q[i] >= opts.threshold) for i in audit}
    todo, width, report = np.arange(len(q)), opts.beam, {"widths": []}
    while len(todo):
        report["widths"].append("scan" if scans(width) else width)
        found, wide = [], []
        for lo in range(0, len(todo), 512):
            own = todo[lo : lo + 512]
            if scans(width):
                sims = q[own] @ exact.T
                a, b = np.nonzero(sims >= floor)
                found.append((own[a], b))
                continue
            ids, sims = graph.beam(q[own], width)
            a, k = np.nonzero(sims >= floor)
            narrow = (sims >= floor).all(axis=1)
            good = ~narrow[a]
            found.append((own[a][good], ids[a, k][good]))
            wide.append(own[narrow])
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        again = np.concatenate(wide) if wide else np.empty(0, np.int64)
        lost = 0
        if not scans(width):
            seen = np.setdiff1d(np.intersect1d(audit, todo), again)
            got = {int(i): set(b[a == i].tolist()) for i in seen}
            lost = sum(len(set(truth[i].tolist()) - got[i]) for i in got)
        if lost:  # an audited query lost a link: all of this width search again
            width *= 4
            continue
        pairs.append((a, b))
        todo, width = again, width * 4
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
    good = np.concatenate([np.einsum("pd,pd->p", q[a[lo : lo + 65536]], exact[b[lo : lo + 65536]]) >= opts.threshold for lo in range(0, len(a), 65536)]) if len(a) else np.empty(0, bool)
    return a[good], b[good], report


_LONGS = pa.list_(pa.int64())
_SHARD = pa.schema([("shard", pa.int64()), ("ids", _LONGS), ("copies", _LONGS), ("x", pa.list_(pa.float64())), ("bottom", pa.list_(pa.int32())), ("nodes", pa.list_(_LONGS)), ("links", pa.list_(_LONGS))])
_GRAPH = "ids array<long>, copies array<long>, x array<double>, bottom array<int>, nodes array<array<long>>, links array<array<long>>"


def _vectors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, copies, unit vectors) of a stored shard."""
    ids = row["ids"].values.to_numpy()
    return ids, row["copies"].values.to_numpy(), row["x"].values.to_numpy().reshape(len(ids), -1)


def _graph(row: dict, x: np.ndarray, opts: Graph) -> Hnsw:
    """The stored graph over its vectors."""
    graph = Hnsw.__new__(Hnsw)
    graph.x, graph.opts, graph.bottom = x.astype(np.float32), opts, row["bottom"].values.to_numpy().reshape(len(x), -1)
    graph.layers = [(np.array(n, np.int64), np.array(k, np.int64).reshape(len(n), -1)) for n, k in zip(row["nodes"].as_py(), row["links"].as_py(), strict=True)]
    return graph


def _build(opts: Graph):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in grouped(batches, "shard"):
            shards = some.column("shard").to_numpy()
            for lo, hi in runs(shards):
                part = some.slice(lo, hi - lo)
                part = part.take(np.argsort(part.column("id").to_numpy(), kind="stable"))
                x = part.column("v").combine_chunks()
                x = unit(x.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float64))
                graph = Hnsw(x, opts)
                row = [shards[lo], part.column("id").to_numpy(), part.column("copies").to_numpy(), x.ravel(), graph.bottom.ravel(), [n.tolist() for n, _ in graph.layers], [k.ravel().tolist() for _, k in graph.layers]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SHARD.types, strict=True)], schema=_SHARD)

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _query(opts: Graph):
    """Rows with two shards' graphs: forest edges (a, b, null) and link counts (a, null, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                target, source = batch.column("target")[k], batch.column("source")[k]
                ids_t, copies_t, x_t = _vectors(target)
                same = batch.column("source_shard")[k] == batch.column("target_shard")[k]
                ids_q, copies_q, x_q = (ids_t, copies_t, x_t) if same else _vectors(source)
                graph = _graph(target, x_t, opts)
                a, b, _ = range_search(graph, x_t, x_q, opts)
                if same:  # either direction counts once for both ends
                    lo, hi = np.minimum(a, b), np.maximum(a, b)
                    both = np.unique(lo[lo != hi] * len(x_t) + hi[lo != hi])
                    a, b = both // len(x_t), both % len(x_t)
                forest, edges = Forest(len(x_q) + (0 if same else len(x_t))), []
                for i, j in zip(a.tolist(), (b if same else b + len(x_q)).tolist(), strict=True):
                    if forest.union(i, j):
                        edges.append((i, j))
                all_ids = ids_q if same else np.concatenate([ids_q, ids_t])
                weight_q = np.bincount(a, weights=copies_t[b], minlength=len(x_q)).astype(np.int64)
                weight_t = np.bincount(b, weights=copies_q[a], minlength=len(x_t)).astype(np.int64)
                weight = weight_q + weight_t if same else np.concatenate([weight_q, weight_t])
                some = np.flatnonzero(weight)
                ea = all_ids[[i for i, _ in edges]] if edges else np.empty(0, np.int64)
                eb = all_ids[[j for _, j in edges]] if edges else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ea, all_ids[some]])), pa.concat_arrays([pa.array(eb, pa.int64()), pa.nulls(len(some), pa.int64())]), pa.concat_arrays([pa.nulls(len(ea), pa.int64()), pa.array(weight[some])])], schema=_LINKS
                )

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", opts: Graph = Graph()) -> DataFrame:
    """Per row: its id, n_links (other vectors linked directly), component_id (smallest id reachable, itself included) and kept.

    Only vectors of equal labels and lengths are compared. A null label, or a vector that is null,
    empty, zero or holds a null or non-finite component, links with nothing. Equal vectors link, and
    repeated ids keep their rows. A row without an id is left with no links and no component.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    clean = F.transform("v", lambda x: x + F.lit(0.0))  # no negative zero
    rows = rows.withColumn("v", F.when(fine, clean)).withColumn("k1", F.when(fine, F.xxhash64("label", clean))).withColumn("k2", F.when(fine, F.xxhash64(F.lit(1), "label", clean)))
    same = rows.where("v IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    reps = staged(same.select(F.xxhash64("k1", "k2").alias("id"), "rep", "copies", "k1", "k2", F.xxhash64("label", F.size("v")).alias("of"), "v"), "vectors")
    groups = reps.groupBy("of").agg(F.ceil(F.count("*") / opts.shard_rows).cast("long").alias("shards"))
    dealt = reps.join(groups, "of").select("id", "copies", "v", "of", F.xxhash64("of", F.pmod(F.xxhash64("id"), F.col("shards"))).alias("shard"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard_of = staged(dealt, "dealt")
    graphs = shard_of.select("shard", "id", "copies", "v").repartition(parts, "shard").sortWithinPartitions("shard")
    graphs = staged(graphs.mapInArrow(_build(opts), f"shard long, {_GRAPH}"), "graphs")
    own = [c for c in graphs.columns if c != "shard"]
    target = graphs.select(F.col("shard").alias("target_shard"), F.struct(*own).alias("target"))
    source = graphs.select(F.col("shard").alias("source_shard"), F.struct("ids", "copies", "x").alias("source"))
    names = shard_of.select("of", "shard").distinct()
    pairs = names.join(names.withColumnRenamed("shard", "other"), "of").where("shard <= other").select(F.col("shard").alias("source_shard"), F.col("other").alias("target_shard"))
    pairs = staged(pairs, "pairs")
    loaded = pairs.join(target, "target_shard")
    alone = loaded.where("source_shard = target_shard").withColumn("source", F.lit(None).cast(source.schema["source"].dataType))
    loaded = alone.unionByName(loaded.where("source_shard <> target_shard").join(source, "source_shard"))
    spread = max(parts, min(pairs.count(), 10_000))
    links = loaded.repartition(spread, "source_shard", "target_shard").mapInArrow(_query(opts), "a long, b long, n long")
    links = staged(links, "links")
    joined = components(links.where("b IS NOT NULL")).select(F.col("node").alias("id"), "component")
    counts = links.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    nodes = reps.select("id", "k1", "k2", "rep", "copies").join(joined, "id", "left").join(counts, "id", "left")
    nodes = nodes.withColumn("comp", F.coalesce("component", "id")).withColumn("n_links", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long"))
    least = nodes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    nodes = staged(nodes.join(least, "comp").select("k1", "k2", "copies", "n_links", "component_id"), "components")
    out = join_skewed(rows.where("k1 IS NOT NULL").select("id", "k1", "k2"), nodes, ["k1", "k2"], "copies").select("id", "n_links", "component_id")
    alone = rows.where("k1 IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))  # link with nothing, and never meet the join
    out = out.unionByName(alone).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
