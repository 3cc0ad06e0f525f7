"""Benchmark decontamination with an FM-index per training shard.

A shard is what one task holds at a time: documents until their indexed words reach ``shard_words``.
Words outside the test phrases' alphabet match nothing, so they only cut a document into runs of
phrase words; a run shorter than the shortest phrase cannot hold one. The shard's index is built
over the rest: suffix array by prefix doubling, Burrows-Wheeler transform, a wavelet matrix for
ranks, suffix positions sampled at every ``sample`` text positions. All phrases are searched
backwards together, their intervals located by walking to the next sampled position, and the
located spans merged per document.

The phrases are the windows of ``window`` words of every item, or all words of a shorter item. They
reach the tasks by broadcast in blocks of at most ``block_windows`` windows; a larger benchmark
takes more passes over the documents, which are numbered and written once for that, not more memory.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import numbered, small_batches, staged

#: A-Z to lower case; all other ASCII but digits and a-z to blanks. Bytes over 0x7F belong to words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass(frozen=True)
class Search:
    window: int = 10
    sample: int = 16
    shard_words: int = 1 << 20
    block_windows: int = 200_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def phrases(items: list[tuple], window: int) -> dict[tuple, list]:
    """Distinct windows of the items with the ids of the items that hold them; items without words have none."""
    found: dict[tuple, list] = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            ids = found.setdefault(tuple(w[i : i + k]), [])
            if item not in ids:
                ids.append(item)
    return found


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s by prefix doubling; s ends in its one smallest symbol."""
    rank, k = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        nxt = np.zeros_like(rank)
        nxt[:-k or None] = rank[k:] + 1
        key = rank * (len(s) + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, k = new, k * 2
        if rank[order[-1]] == len(s) - 1 or k >= len(s):
            return order


class WaveletMatrix:
    """rank(symbol, i): how often a symbol occurs before position i; vectorised over symbols and positions."""

    def __init__(self, s: np.ndarray):
        self.levels = max(1, int(s.max()).bit_length())
        self.ones: list[np.ndarray] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(i), i
        for level, ones in zip(range(self.levels - 1, -1, -1), self.ones, strict=True):
            bit = (symbol >> level) & 1
            zeros = len(ones) - 1 - int(ones[-1])
            start = np.where(bit, zeros + ones[start], start - ones[start])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - start

    def at(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for ones in self.ones:
            bit = ones[i + 1] - ones[i]
            zeros = len(ones) - 1 - int(ones[-1])
            i = np.where(bit, zeros + ones[i], i - ones[i])
            symbol = symbol * 2 + bit
        return symbol


class FMIndex:
    """Count and locate phrases in a sequence of symbols >= 1; 0 ends it."""

    def __init__(self, s: np.ndarray, sample: int):
        s = np.append(s, 0).astype(np.int64)
        order = suffix_array(s)
        bwt = s[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=int(s.max()) + 1))])
        self.tree = WaveletMatrix(bwt)
        self.marked = np.concatenate([[0], np.cumsum(order % sample == 0)])
        self.positions = order[order % sample == 0]
        self.size = len(s)

    def intervals(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns, rows right-aligned and padded with -1 on the left."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for column in patterns.T[::-1]:
            live = np.flatnonzero((column >= 0) & (hi > lo))
            c = column[live]
            known = c < len(self.below) - 1
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live] = self.below[c] + self.tree.rank(c, lo[live])
            hi[live] = self.below[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows, each by steps back to a sampled one."""
        found, steps, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            now = rows[left]
            done = self.marked[now + 1] > self.marked[now]
            at = left[done]
            found[at] = self.positions[self.marked[rows[at]]] + steps[at]
            left = left[~done]
            symbol = self.tree.at(rows[left])
            rows[left] = self.below[symbol] + self.tree.rank(symbol, rows[left])
            steps[left] += 1
        return found


class _Phrases:
    """A block of phrases as symbols. 1 cuts runs; words have 2 and up."""

    def __init__(self, found: dict[tuple, list]):
        self.symbol: dict[bytes, int] = {}
        for phrase in found:
            for w in phrase:
                self.symbol.setdefault(w, len(self.symbol) + 2)
        self.lengths = np.array([len(p) for p in found], np.int64)
        width = int(self.lengths.max(initial=1))
        self.patterns = np.full((len(found), width), -1, np.int64)
        for row, p in zip(self.patterns, found, strict=True):
            row[width - len(p) :] = [self.symbol[w] for w in p]
        self.items = list(found.values())
        self.shortest = int(self.lengths.min(initial=width))


def _hits(shard: list[tuple[np.ndarray, np.ndarray, int]], block: _Phrases, sample: int) -> dict[int, tuple[list, list, set]]:
    """For documents of a shard, given as (symbols, word positions, row): spans and items found."""
    text = np.concatenate([s for s, _, _ in shard])
    where = np.concatenate([p for _, p, _ in shard])
    row = np.repeat([r for _, _, r in shard], [len(s) for s, _, _ in shard])
    index = FMIndex(text, sample)
    lo, hi = index.intervals(block.patterns)
    phrase = np.repeat(np.arange(len(lo)), hi - lo)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[phrase]
    at = index.locate(rows)
    out: dict[int, tuple[list, list, set]] = {}
    for r, start, p in zip(row[at].tolist(), where[at].tolist(), phrase.tolist(), strict=True):
        starts, ends, items = out.setdefault(r, ([], [], set()))
        starts.append(start)
        ends.append(start + int(block.lengths[p]))
        items.update(block.items[p])
    return out


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(block_of, item_type: pa.DataType, opts: Search):
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(item_type))])

    def flush(ids: list, rows: list, counts: list, shard: list, block: _Phrases) -> pa.RecordBatch:
        hits = _hits(shard, block, opts.sample) if shard else {}
        spans = [merged(*hits[i][:2]) if i in hits else [] for i in range(len(ids))]
        items = [sorted(hits[i][2], key=lambda x: (x is None, x)) if i in hits else [] for i in range(len(ids))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(counts, pa.int64()), pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int64())), pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int64())), pa.array(items, pa.list_(item_type))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, counts, shard, held = block_of(), [], [], [], [], 0
        get = block.symbol.get
        for batch in batches:
            for i, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words(text)
                s = np.fromiter(map(get, w, [1] * len(w)), np.int64, len(w))
                cut = np.flatnonzero(np.concatenate([[True], s == 1, [True]]))  # runs between these
                long = np.flatnonzero(np.diff(cut) - 1 >= block.shortest)
                if len(long):
                    parts = [np.arange(cut[k], cut[k + 1] - 1) for k in long.tolist()]
                    symbols = np.concatenate([np.append(s[p], 1) for p in parts])
                    shard.append((symbols, np.concatenate([np.append(p, -1) for p in parts]), len(ids)))
                    held += len(symbols)
                ids.append(i)
                rows.append(row)
                counts.append(len(w))
                if held >= opts.shard_words or len(ids) >= 200_000:
                    yield flush(ids, rows, counts, shard, block)
                    ids, rows, counts, shard, held = [], [], [], [], 0
        if ids:
            yield flush(ids, rows, counts, shard, block)

    return run


def _blocks(items: DataFrame, opts: Search) -> Iterator[list[tuple]]:
    """The items in blocks of bounded numbers of windows; the caller holds no more than two at a time."""
    block, size = [], 0
    for item, text in items.toLocalIterator(prefetchPartitions=False):
        n = max(1, len(words(text)) - opts.window + 1)
        if block and size + n > opts.block_windows:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", opts: Search = Search()) -> DataFrame:
    """Per row of docs: id, n_words, spans (merged, by word position, end exclusive) and the items with occurring windows.

    A word is a run of letters, digits and non-ASCII characters, A-Z lowered. A null text has no words;
    an item without words has no window. Items of equal ids count once, and so do all items without one
    (as a null). Rows of equal or null ids are each judged by their own text. Tables may be empty.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    item_type = pa.string() if dict(items.dtypes)[item_col] == "string" else pa.int64()
    kind = "string" if item_type == pa.string() else "long"
    schema = f"id long, row long, n_words long, starts array<long>, ends array<long>, items array<{kind}>"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_col).cast(kind).alias("item"), F.col(item_text).alias("text"))
    done: DataFrame | None = None
    blocks = _blocks(wanted, opts)
    ahead = list(itertools.islice(blocks, 2))
    texts = numbered(texts, "row", "texts") if len(ahead) > 1 else texts.withColumn("row", F.lit(None).cast("long"))
    texts = texts.select("id", "row", "text")
    for n, block in enumerate(itertools.chain(ahead, blocks)):
        shared = spark.sparkContext.broadcast([(i, t) for i, t in block])

        def block_of(shared=shared) -> _Phrases:
            return _Phrases(phrases(shared.value, opts.window))

        found = texts.mapInArrow(_search(block_of, item_type, opts), schema)
        if done is None:
            done = found
        else:
            done = staged(done.unionByName(found), f"blocks-{n}")
            done = done.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select(found.columns)
    starts_ends = F.array_sort(F.arrays_zip("starts", "ends"))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    spans = F.aggregate(
        starts_ends,
        empty,
        lambda acc, x: F.when((F.size(acc) > 0) & (x["starts"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(x["ends"], F.try_element_at(acc, F.lit(-1))["end"]).alias("end"))))).otherwise(
            F.concat(acc, F.array(F.struct(x["starts"].alias("start"), x["ends"].alias("end"))))
        ),
    )
    return done.select(F.col("id").alias(id_col), "n_words", spans.alias("spans"), "items")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of contamination()'s spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them; all else is kept as it is."""
    data = text.encode("utf-8", "surrogatepass")
    plain = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], plain.view(np.int8), [0]])))
    first, last = edge[0::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : first[a]])
        at = int(last[b - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")
