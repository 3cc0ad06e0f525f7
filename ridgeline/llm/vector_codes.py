"""Vector code compression: product codes by k-means with norm-of-sum bounds.

A vector of integers is cut into equal parts; every part position has a codebook. A round assigns each
part to its nearest entry and moves the entries to their parts' means, rounded down. All distances are
integers and exact, ties go to the lower index.

Entries come in groups. Each part keeps its entry and, per group, a lower bound on the distance to the
group's other entries with a stamp: the round in which the bound was exact. Codebooks of all rounds
are kept, so a bound of round s holds in round t less the largest net displacement |c(t) - c(s)| of the
group's entries. That is the norm of the sum of their moves, never more than the sum of the norms that
bounds which are moved on every round would lose. A group whose bound stays above the distance to the
own entry has no nearer one and no equal one; only the other groups are scanned again, and get the
stamp of this round.

The state of a row (entries, bounds, stamps) is written with it from round to round; a task returns a
sum and a count per entry, and the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import join_skewed, small_batches, staged

@dataclass(frozen=True)
class Codes:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    groups: int = 4


def _exact(most: float, components: int) -> bool:
    """Whether sums of squares of differences up to ``most`` are exact as doubles."""
    return float(most) ** 2 * components < 1 << 52


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries. Products of large components are taken as Python numbers."""
    big = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if _exact(2 * big, x.shape[1]):
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(object), entries.astype(object)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a.dot(b.T)


def _roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def displacements(history: np.ndarray, group_of: np.ndarray) -> np.ndarray:
    """(rounds so far, groups): the largest net displacement of a group's entries from each round to the last, rounded up."""
    moved = history[-1].astype(np.float64) - history
    norm = np.sqrt((moved * moved).sum(axis=2)) * (1 + 1e-9)
    return np.stack([norm[:, group_of == g].max(axis=1, initial=0) for g in range(group_of.max() + 1)], axis=1)


class Part:
    """One part position: assignment of rows with bounds. history: codebooks of all rounds, (rounds, entries, components)."""

    def __init__(self, history: np.ndarray, groups: int):
        n = history.shape[1]
        self.history, self.now, self.round = history, history[-1], len(history) - 1
        self.group_of = np.arange(n) * min(groups, n) // n
        self.drift = displacements(history, self.group_of)
        self.scans = 0

    def assign(self, x: np.ndarray, code: np.ndarray | None, low: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per row; low and stamp (rows, groups) are brought up to date in place. Without codes all groups are scanned."""
        n, rows = len(x), np.arange(len(x))
        if code is None:
            near, best, need = np.zeros(n, np.int64), None, np.ones(low.shape, bool)
        else:
            near = code.astype(np.int64)
            off = x - self.now[near]
            best = (off.astype(np.float64) ** 2).sum(axis=1).astype(np.int64) if _exact(np.abs(off).max(initial=0), x.shape[1]) else (off.astype(object) ** 2).sum(axis=1)
            bound = low.astype(np.float64) - self.drift[stamp, np.arange(low.shape[1])]
            need = bound <= (_roots(best) * (1 + 1e-9))[:, None]
        found, least, old = near.copy(), best, near
        scanned = []
        for g in range(low.shape[1]):
            own = np.flatnonzero(need[:, g])
            if not len(own):
                continue
            entries = np.flatnonzero(self.group_of == g)
            d = distances(x[own], self.now[entries])
            self.scans += d.size
            first = d.argmin(axis=1)
            value = d[np.arange(len(own)), first]
            scanned.append((g, own, entries, d))
            if least is None:
                found, least = entries[first], value
                continue
            better = (value < least[own]) | (value == least[own]) & (entries[first] < found[own])
            found = found.copy()
            least = least.copy()
            found[own[better]], least[own[better]] = entries[first[better]], value[better]
        for g, own, entries, d in scanned:
            others = _roots(d)
            mine = found[own]
            inside = self.group_of[mine] == g
            others[np.flatnonzero(inside), mine[inside] - entries[0]] = np.inf
            low[own, g] = np.nextafter(others.min(axis=1).astype(np.float32), np.float32(-1))
            stamp[own, g] = self.round
        if code is not None:  # an entry left for one of another group is now one of its own group's others
            g = self.group_of[old]
            left = (found != old) & ~need[rows, g]
            low[left, g[left]] = np.nextafter(_roots(best[left]).astype(np.float32), np.float32(-1))
            stamp[left, g[left]] = self.round
        return found, least


_STATE = "id long, label string, v array<long>, code binary, low array<float>, stamp binary"
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _blocks(batch: pa.RecordBatch, opts: Codes) -> np.ndarray:
    v = batch.column("v").flatten().to_numpy()
    return v.reshape(batch.num_rows, opts.parts, -1)


def _bytes(column: pa.Array, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(shape).copy()


def _binary(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values, np.uint8).reshape(len(values), -1)
    return pa.array([row.tobytes() for row in flat], pa.binary())


def _assigned(batch: pa.RecordBatch, parts: list[Part], opts: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, squared distances, bounds and stamps of a batch."""
    n, g = batch.num_rows, int(parts[0].group_of.max()) + 1
    x = _blocks(batch, opts)
    fresh = batch.column("code").null_count == n
    old = None if fresh else _bytes(batch.column("code"), n, opts.parts)
    low = np.zeros((n, opts.parts, g), np.float32) if fresh else batch.column("low").flatten().to_numpy().reshape(n, opts.parts, g).copy()
    stamp = np.zeros((n, opts.parts, g), np.uint8) if fresh else _bytes(batch.column("stamp"), n, opts.parts, g)
    code, error = np.empty((n, opts.parts), np.int64), np.empty((n, opts.parts), object)
    for p, part in enumerate(parts):
        code[:, p], error[:, p] = part.assign(x[:, p], None if old is None else old[:, p], low[:, p], stamp[:, p])
    return code, error, low, stamp


def _move(shared, opts: Codes):
    """Rows with their new state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(h, opts.groups) for h in shared.value]
        for batch in batches:
            if batch.num_rows:
                code, _, low, stamp = _assigned(batch, parts, opts)
                width = low[0].size
                lows = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * width), pa.array(low.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), _binary(code), lows, _binary(stamp)], names=["id", "label", "v", "code", "low", "stamp"])

    return run


def _sums(n_entries: int, opts: Codes):
    """Count and sum of the parts of each entry, one row each for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        count = np.zeros((opts.parts, n_entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = _blocks(batch, opts), _bytes(batch.column("code"), batch.num_rows, opts.parts)
            total = np.zeros((opts.parts, n_entries, x.shape[2]), np.int64) if total is None else total
            for p in range(opts.parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=n_entries)
        if total is not None:
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], schema=_SUMS)

    return run


def _finish(shared, opts: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(h, opts.groups) for h in shared.value]
        for batch in batches:
            if batch.num_rows:
                code, error, _, _ = _assigned(batch, parts, opts)
                text = [row.astype(np.uint8).tobytes().hex() for row in code]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text), pa.array([int(e) for e in error.sum(axis=1)], pa.int64())], names=["id", "label", "code", "error"])

    return run


def _first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the n smallest ids. The smallest ids of buckets bound them from above, so that few rows are sorted."""
    least = rows.where("id IS NOT NULL").groupBy(F.pmod(F.xxhash64("id"), F.lit(16 * n)).alias("b")).agg(F.min("id").alias("m"))
    least = [r.m for r in least.orderBy("m").select("m").limit(n).collect()]
    rows = rows.where("id IS NOT NULL")
    return (rows.where(F.col("id") <= least[-1]) if len(least) == n else rows).orderBy("id", "v").limit(n)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", opts: Codes = Codes()) -> DataFrame:
    """Per kept row: id, code (hex, two digits for each part), error, label_error and codebooks_sha256.

    A component x becomes floor(scale x). Rows go whose vector is null, empty or holds a null or
    non-finite component, or has another length than the first kept one (by id), which must be a
    multiple of ``parts``: else no row is kept. Codebooks start from the ``entries`` smallest ids, by
    vector where ids are equal; a row without an id is coded but starts none. Equal rows are coded
    each. label_error sums the errors of equal labels, nulls together. An empty table gives an empty table.
    """
    if opts.entries > 256 or opts.rounds > 255:
        raise ValueError("an entry and a round must each fit in a byte")
    spark = vectors.sparkSession
    small_batches(spark)
    share = spark.sparkContext.broadcast
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size("v") > 0) & (F.size("v") % opts.parts == 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).where(fine)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * opts.scale).cast("long")))
    start = [r.v for r in _first_rows(rows, opts.entries).select("v").collect()]
    rows = rows.where(F.size("v") == (len(start[0]) if start else 0))
    start = [x for x in start if len(x) == len(start[0])]
    if not start:
        names = f"{id_col} long, code string, error long, label_error long, codebooks_sha256 string"
        return rows.where("false").select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in names.split(", ")])
    books = np.array(start, np.int64).reshape(len(start), opts.parts, -1).transpose(1, 0, 2)  # part, entry, component
    history = [books]
    width = books.shape[2]
    blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ("code binary", "low array<float>", "stamp binary")]
    state = rows.select("id", "label", "v", *blank)

    def shared():
        return share([np.stack([h[p] for h in history]) for p in range(opts.parts)])

    for k in range(opts.rounds):
        state = staged(state.mapInArrow(_move(shared(), opts), _STATE), f"codes-{k}")
        sums = state.mapInArrow(_sums(len(start), opts), "part int, entry int, n long, sums array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums"))
        books = books.copy()
        for r in sums.collect():  # parts x entries rows
            books[r.part, r.entry] = [s // r.n for s in r.sums]
        history.append(books)
    coded = staged(state.mapInArrow(_finish(shared(), opts), "id long, label string, code string, error long"), "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    key = [F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit("")).alias("_label")]
    coded = coded.select("id", "code", "error", *key)
    sums = staged(coded.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies")), "label-errors")
    found = join_skewed(coded, sums, ["_none", "_label"], "copies")
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
