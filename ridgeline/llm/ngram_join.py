"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection.

Two documents link when the Jaccard similarity of their sets of word n-grams reaches a threshold t.

1. One pass over the texts gives each document its set size, a digest of the set, a bitmap signature
   (as many bits as two to four times the set size, a power of two) and its tiles. A tile belongs to a
   size band: sets of sizes from (1/t)^b to (1/t)^(b+1), and as guests the larger ones that may link
   with them. In a band, linked sets differ in at most k n-grams, so if n-grams are dealt by hash to
   more than k parts, linked sets agree in a whole part: one tile for each part's content. That finds
   every link, whatever the texts share. With 3 k // 10 parts more, linked sets agree in that many
   more, so each set leaves out its emptiest parts, up to as many: of the parts that two sets agree in,
   one is too full to be left out by either.
2. Documents with equal sets are one node. Nodes that meet in one of the first ``quick`` parts are
   compared: in a tile, only sizes within the threshold's ratio, and the bit counts of the bitmaps
   bound the overlap from above; the surviving pairs leave as a spanning forest, whose components are
   clusters. Tiles of other parts matter only where different clusters, or nodes without one, meet in
   them, which one pass over (tile, cluster) pairs tells, made distinct before the shuffle; those are
   compared likewise.
   A tile of more than ``tile_rows`` nodes is cut into blocks, and pairs of blocks become tiles.
3. The components of all forests are the final clusters. Only for their members are the sets built
   again, as sorted arrays; a cluster's pairs are compared once, in tiles of bounded bytes, by size,
   bitmap bound and exact intersection, skipping pairs already connected. Forests leave again, and
   their components are the result: every link between different texts counts, no pair list exists.

Equal 64-bit hashes of different n-grams count as equal.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Forest, components, few_enough, grouped, hint, join_skewed, runs, small_batches, staged

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Rule:
    """n-gram length and the threshold as the fraction num / den; quick: parts looked at first, which spares most tiles of the others.

    node_bits: of a set's digest, its number; sets of one number get others.
    """

    n: int = 4
    num: int = 85
    den: int = 100
    tile_rows: int = 700
    quick: int = 4
    tile_bytes: int = 32 << 20
    broadcast_rows: int = 1_000_000
    node_bits: int = 64


class _WordHashes(dict):
    """Hash of a word, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of all words if these are fewer; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, \x20 \x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX[0]
        out ^= out >> np.uint64(29)
    out = (out * _MIX[1]) ^ (out >> np.uint64(32))
    return np.unique(out * _MIX[2])


@functools.lru_cache(maxsize=4096)
def band_parts(band: int, num: int, den: int) -> tuple[int, int, int]:
    """(largest size of a guest, parts, parts that may be left out) of a size band's tiles."""
    small = math.ceil((den / num) ** (band + 1)) + 1
    while band_of(small, num, den) > band:
        small -= 1
    large = small * den // num
    differ = (den - num) * (small + large) // (den + num)
    return large, differ + 1 + 3 * differ // 10, 3 * differ // 10


def band_of(size: int, num: int, den: int) -> int:
    return math.floor(math.log(size) / math.log(den / num) + 1e-9)


def tiles_of(values: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The tiles of a set's first ``quick`` parts, and those of its others, in its own band and as a guest of the one below."""
    own = band_of(len(values), rule.num, rule.den)
    first, others = [], []
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.float64), (values >> np.uint64(32)).astype(np.float64)
    for band in range(own, max(own - 2, -1), -1):
        large, parts, spare = band_parts(band, rule.num, rule.den)
        if len(values) > large:
            continue
        part = (((values * _MIX[1]) >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
        count = np.bincount(part, minlength=parts)
        content = np.bincount(part, low, parts).astype(np.uint64) + (np.bincount(part, high, parts).astype(np.uint64) << np.uint64(32))
        place = np.arange(parts, dtype=np.uint64)
        tile = (content ^ (place * _MIX[2])) * _MIX[0] + np.uint64((band + 1) * int(_MIX[1]) & (1 << 64) - 1)
        tile = (tile ^ (tile >> np.uint64(29))) * _MIX[2]
        kept = count >= np.partition(count, spare)[spare]
        first.append(tile[: rule.quick][kept[: rule.quick]])
        others.append(tile[rule.quick :][kept[rule.quick :]])
    return np.concatenate(first).view(np.int64), np.concatenate(others).view(np.int64)


def bitmap(values: np.ndarray) -> bytes:
    bits = 64
    while bits < 2 * len(values):
        bits *= 2
    flags = np.zeros(bits, np.uint8)
    flags[(values & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(bits, np.uint64)
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0) if len(words) > size else words


def tile_links(sizes: np.ndarray, bits: list[bytes], rule: Rule, exact=None, forest: Forest | None = None) -> list[tuple[int, int]]:
    """Spanning forest of a tile's pairs that pass the size band, the bitmap bound and, if given, exact(i, j).

    Rows must come in ascending order of size. A pair already connected is not looked at.
    """
    n, num, den = len(sizes), rule.num, rule.den
    out: list[tuple[int, int]] = []
    if n < 2:
        return out
    forest = forest or Forest(n)
    root = np.arange(n)
    members: dict[int, list[int]] = {}
    ends = np.searchsorted(sizes, sizes * den // num, side="right")
    width = [len(b) // 8 for b in bits]
    widths = sorted(set(width))
    planes: dict[int, np.ndarray] = {}
    first = {w: next(i for i in range(n) if width[i] >= w) for w in widths}
    for w in widths:  # rows of at least this width, folded to it
        planes[w] = np.stack([_folded(b, w) for b in bits[first[w] :]]) if w == widths[0] or n > first[w] else None
    for i in range(n - 1):
        w, end = width[i], int(ends[i])
        if end <= i + 1:
            continue
        others = np.flatnonzero(root[i + 1 : end] != root[i]) + i + 1
        if not len(others):
            continue
        base = first[w]
        mine, theirs = planes[w][i - base], planes[w][others - base]
        both = np.bitwise_and(theirs, mine)
        common = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        only_i = int(np.bitwise_count(mine).sum()) - common
        only_j = np.bitwise_count(theirs).sum(axis=1, dtype=np.int64) - common
        most = np.minimum(sizes[i] - only_i, sizes[others] - only_j)
        for j in others[most * (num + den) >= num * (sizes[i] + sizes[others])].tolist():
            if root[i] != root[j] and (exact is None or exact(i, j)):
                out.append((i, j))
                a, b = sorted((int(root[i]), int(root[j])))
                moved = members.pop(b, [b])
                members.setdefault(a, [a]).extend(moved)
                root[moved] = a
    return out


def _features(rule: Rule):
    longs = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("node", pa.int64()), ("bits", pa.binary()), ("quick", longs), ("others", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = _WordHashes(), (1 << rule.node_bits) - 1 if rule.node_bits < 64 else -1
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                s = shingles(text, rule.n, hashes)
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                row = (len(s), key, int.from_bytes(key[:8], "little", signed=True) & mask, bitmap(s), *tiles_of(s, rule)) if key else (0, None, None, None, None, None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(out, schema.types[1:], strict=True)]], schema=schema)

    return run, "id long, n long, key binary, node long, bits binary, quick array<long>, others array<long>"


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, but all with a zero."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (b[1:] == 0)]) if len(a) else np.empty(0, bool)
    return a[new], b[new]


def _tile_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, cluster) of rows (tiles, cluster), each pair once for a quarter of a million: a group of copies is one row then."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        tile, cluster = _distinct_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(cluster)], names=["tile", "cluster"])

    for batch in batches:
        lists = batch.column("tiles")
        held.append((lists.flatten().to_numpy(), np.repeat(batch.column("cluster").to_numpy(), np.diff(lists.offsets.to_numpy()))))
        if sum(len(t) for t, _ in held) > 250_000:
            yield flush()
            held = []
    if held:
        yield flush()


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles, of rows (tile, cluster) sorted by tile, in which different clusters meet, or one with a node of none (0); holds no tile's rows."""
    last: tuple[int, int, bool] | None = None  # tile, its first cluster, and whether a node of none was in it
    told: int | None = None
    for batch in batches:
        tile, cluster = (batch.column(c).to_numpy() for c in ("tile", "cluster"))
        if not len(tile):
            continue
        start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        length = np.diff(np.append(start, len(tile)))
        first, lone = cluster[start], np.logical_or.reduceat(cluster == 0, start)
        if last is not None and last[0] == tile[0]:
            first[0] = last[1]
            lone[0] |= last[2]
            length[0] += 1
        differs = np.logical_or.reduceat(cluster != np.repeat(first, np.diff(np.append(start, len(tile)))), start) | lone & (length > 1)
        found = tile[start][differs]
        if len(found) and found[0] == told:
            found = found[1:]
        last = int(tile[-1]), int(first[-1]), bool(lone[-1])
        told = int(found[-1]) if len(found) else told
        yield pa.RecordBatch.from_arrays([pa.array(found)], names=["tile"])


def _arrays(rule: Rule):
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int64()), ("blocks", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingles(t, rule.n, hashes) for t in batch.column("text").to_pylist()]
            keys = batch.column("key").to_pylist()
            right = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == keys[i]]  # an id may have other texts
            batch, sets = batch.take(pa.array(right, pa.int64())), [sets[i] for i in right]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), batch.column("blocks"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run, "id long, cluster long, blocks long, n long, hashes binary"


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tiles(rule: Rule, sets: bool):
    """Kernel over rows sorted by tile: ids, sizes and bitmaps, or whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "tile"):
            tiles, ids, sizes = (table.column(c).to_numpy() for c in ("tile", "id", "n"))
            data = table.column("hashes" if sets else "bits")
            a, b = [], []
            for lo, hi in runs(tiles):
                order = lo + np.argsort(sizes[lo:hi], kind="stable")
                values = [data[int(k)].as_py() for k in order]
                if sets:
                    arrays = [np.frombuffer(v, np.uint64) for v in values]
                    values = [bitmap(v) for v in arrays]

                    def exact(i: int, j: int, arrays=arrays) -> bool:
                        both = len(np.intersect1d(arrays[i], arrays[j], assume_unique=True))
                        return rule.den * both >= rule.num * (len(arrays[i]) + len(arrays[j]) - both)

                for i, j in tile_links(sizes[order], values, rule, exact if sets else None):
                    a.append(int(ids[order[i]]))
                    b.append(int(ids[order[j]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)

    return run, "a long, b long"


def _in_tiles(rows: DataFrame, rule: Rule, sets: bool, parts: int) -> DataFrame:
    run, schema = _tiles(rule, sets)
    return rows.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(run, schema)


def _blocked(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of a group of ``blocks`` > 1 go to every tile that pairs their own block with another."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    many = rows.where("blocks > 1").withColumn("_own", own).withColumn("_other", other)
    many = many.withColumn("tile", F.xxhash64(*key, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other")
    return rows.where("blocks = 1").withColumn("tile", F.xxhash64(*key)).unionByName(many)


def _compared(rows: DataFrame, nodes: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """Forest edges between nodes that pass the bitmap bound in a tile. rows: key (the tile), id (the node)."""
    rows = rows.distinct()
    counts = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = rows.join(counts, "key").select("key", "id", F.ceil(F.col("c") / rule.tile_rows).cast("long").alias("blocks"))
    rows = _blocked(shared, "key").select("tile", "id").join(nodes.select("id", "n", "bits"), "id")
    return _in_tiles(rows, rule, False, parts)


def _candidates(found: DataFrame, nodes: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """Edges between nodes that may link: by the first parts, then by the tiles of others in which clusters meet."""
    quick = found.select(F.explode("quick").alias("key"), F.col("node").alias("id"))
    edges = staged(_compared(quick, nodes, rule, parts), "quick")
    clusters = components(edges).select(F.col("node").alias("id"), F.when(F.col("component") == 0, 1).otherwise(F.col("component")).alias("cluster"))
    copies = nodes.where("c > 1").join(clusters, "id", "left_anti").select("id", F.when(F.col("id") == 0, 1).otherwise(F.col("id")).alias("cluster"))
    marks = hint(staged(clusters.unionByName(copies), "quick-clusters"), rule.broadcast_rows)
    own = found.select(F.col("node").alias("id"), F.col("others").alias("tiles")).join(marks, "id", "left").select("tiles", F.coalesce("cluster", F.lit(0).cast("long")).alias("cluster"))
    pairs = own.mapInArrow(_tile_clusters, "tile long, cluster long").repartition(parts, "tile").sortWithinPartitions("tile")
    mixed = staged(pairs.mapInArrow(_mixed, "tile long"), "mixed")
    others = found.select(F.explode("others").alias("key"), F.col("node").alias("id")).join(hint(mixed.withColumnRenamed("tile", "key"), rule.broadcast_rows), "key", "left_semi")
    return edges.unionByName(staged(_compared(others, nodes, rule, parts), "others"))


def _numbered_apart(usable: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different sets that share a number, a handful of all, get numbers of their own."""
    twice = nodes.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    if few_enough(twice, 0):
        return usable, nodes
    for k in range(100):
        own = staged(nodes.join(hint(twice, 1_000_000), "id").select("key", F.xxhash64("key", F.lit(k)).alias("own")), "apart")
        other = own.groupBy("own").agg(F.count("*").alias("k")).where("k > 1").select("own").unionByName(nodes.join(own, F.col("id") == F.col("own"), "left_semi").select(F.col("id").alias("own")))
        if few_enough(other, 0):
            break
    else:
        raise ValueError("no numbers of their own for sets that share one")
    own = hint(own, 1_000_000)
    nodes = staged(nodes.join(own, "key", "left").withColumn("id", F.coalesce("own", "id")).drop("own"), "nodes")
    return usable.join(own, "key", "left").withColumn("node", F.coalesce("own", "node")).drop("own"), nodes


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """Per row of docs: its id, n_shingles (set size) and component_id (smallest id reachable by links, itself included).

    A null or wordless text has an empty set and links with nothing. Rows of one id are judged each
    by its own text; a row without an id links with nothing and has no component.
    Equal texts link. Other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    run, schema = _features(rule)
    found = staged(texts.mapInArrow(run, schema), "features")
    usable = found.where("n > 0 AND id IS NOT NULL")
    # an id may have several texts: the nodes are the sets, until the end
    nodes = usable.groupBy(F.col("node").alias("id"), "key", "n").agg(F.min("id").alias("rep"), F.first("bits").alias("bits"), F.count("*").alias("c"))
    nodes = staged(nodes, "nodes")
    usable, nodes = _numbered_apart(usable, nodes)
    edges = staged(_candidates(usable, nodes, rule, parts), "candidates")
    clusters = components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    clustered = staged(nodes.select("id", "rep", "n", "key").join(clusters, "id"), "clusters")
    sizes = clustered.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") * 8 / rule.tile_bytes), F.ceil(F.count("*") / (8 * rule.tile_rows))).cast("long").alias("blocks"))
    wanted = clustered.join(sizes, "cluster").select(F.col("id").alias("node"), "rep", "key", "cluster", "blocks")
    if few_enough(clustered, rule.broadcast_rows):
        wanted = F.broadcast(wanted)
    run, schema = _arrays(rule)
    sets = texts.join(wanted, texts["id"] == F.col("rep")).select(F.col("node").alias("id"), "cluster", "blocks", "key", "text").mapInArrow(run, schema)
    links = staged(_in_tiles(_blocked(sets, "cluster").select("tile", "id", "n", "hashes"), rule, True, parts), "links")
    joined = components(links).select(F.col("node").alias("id"), "component")
    named = nodes.select("id", "rep", "c").join(joined, "id", "left").select("id", "rep", "c", F.coalesce("component", "id").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = staged(named.join(least, "comp").select(F.col("id").alias("node"), "c", "component_id"), "components")
    # rows without a set meet nothing, and never the join
    out = join_skewed(usable.select("id", "n", "node"), named, ["node"], "c").select("id", "n", "component_id")
    out = out.unionByName(found.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
