"""Token-id shards: raw id payloads with a minimal perfect hash index from document key to offset.

One shard is one file: a header, the ids of its documents in ascending key order (16-bit ids where
the vocabulary allows it, else 32-bit), the documents' offsets, and the index. The index is a
minimal perfect hash over the shard's distinct keys (compress, hash and displace): a key's bucket
gives a displacement, which gives its one slot; the slot holds a fingerprint of the key, the ordinal
of its first document and how many follow with the same key. A lookup reads one displacement and one
slot and is refused if the fingerprint differs; keys themselves are not stored.

The writer sorts documents by key range, so that shards follow each other in key order, and returns
a manifest with one row per shard. A task that runs again writes a file of another name; only the
files that the manifest names count.
"""

from __future__ import annotations

import functools
import gc
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.bpe import CHUNK_CHARS, PieceCoder, chunks, cores
from ridgeline.llm.common import hint, small_batches, staged, work_dir

MAGIC = b"RLIDS001"
_HEADER = struct.Struct("<8sIIQQQQ")  # magic, bytes of an id, seed, documents, ids, keys, buckets
NO_KEY = -(1 << 63)  # stands for a null key
SHARD_IDS = 4 << 20
ENCODED_TOGETHER = 5000
#: Pieces that a worker keeps, some 170 bytes each; the keys of 699,050 at most are a dict half as large as of more.
ENCODED_PIECES = 600_000


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of keys, with a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: slot = hash(key, its bucket's displacement) modulo n."""

    def __init__(self, displacement: np.ndarray, n: int, seed: int):
        self.displacement, self.n, self.seed = displacement, n, seed

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // 3)
        for seed in range(1, 100):
            h = mixed(keys, seed)
            bucket = (mixed(keys, -seed) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            count = np.bincount(bucket, minlength=buckets)
            start = np.cumsum(count) - count
            taken, displacement = np.zeros(n, bool), np.zeros(buckets, np.int64)
            free, failed = 0, False
            for b in np.argsort(-count, kind="stable").tolist():
                if count[b] == 0 or failed:
                    break
                own = h[order[start[b] : start[b] + count[b]]]
                if count[b] == 1:  # straight to a free slot
                    while taken[free]:
                        free += 1
                    displacement[b], taken[free] = -free - 1, True
                    continue
                failed = True
                for lo in range(0, 64 * n + 4096, 256):
                    slots = cls._places(own, np.arange(lo, lo + 256)[:, None], n)
                    fits = ~taken[slots].any(axis=1)
                    if len(own) > 1:
                        ordered = np.sort(slots, axis=1)
                        fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                    if fits.any():
                        d = int(fits.argmax())
                        displacement[b], failed = lo + d, False
                        taken[slots[d]] = True
                        break
            if not failed:
                return cls(displacement, n, seed)
        raise ValueError("no perfect hash found")

    @staticmethod
    def _places(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        return (mixed(h ^ mixed(d, 77), 5) % np.uint64(n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.displacement[(mixed(keys, -self.seed) % np.uint64(len(self.displacement))).astype(np.int64)]
        return np.where(d < 0, -d - 1, self._places(mixed(keys, self.seed), np.maximum(d, 0), self.n))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 0x5EED) >> np.uint64(32)).astype(np.uint32)


def shard_bytes(keys: np.ndarray, ids: list[np.ndarray], width: int) -> bytes:
    """A shard's file from its documents in ascending key order."""
    distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    table = np.zeros((3, len(distinct)), np.uint32)
    table[0, slots], table[1, slots], table[2, slots] = fingerprints(distinct), first, copies
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    payload = b"".join(x.astype(f"<u{width}").tobytes() for x in ids)
    header = _HEADER.pack(MAGIC, width, index.seed, len(keys), int(offsets[-1]), len(distinct), len(index.displacement))
    return b"".join([header, payload, offsets.tobytes(), index.displacement.astype("<i8").tobytes(), table.astype("<u4").tobytes()])


class Shard:
    """Keyed access to a shard file's bytes."""

    def __init__(self, data: bytes):
        magic, width, seed, docs, ids, keys, buckets = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = _HEADER.size
        self.ids = np.frombuffer(data, f"<u{width}", ids, at)
        at += ids * width
        self.offsets = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        displacement = np.frombuffer(data, "<i8", buckets, at)
        at += 8 * buckets
        self.table = np.frombuffer(data, "<u4", 3 * keys, at).reshape(3, keys)
        self.index = PerfectHash(displacement, keys, seed)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal of the key's first document, number of its documents); (-1, 0) if the fingerprint differs."""
        slots = self.index.slots(keys)
        known = self.table[0, slots] == fingerprints(keys)
        return np.where(known, self.table[1, slots].astype(np.int64), -1), np.where(known, self.table[2, slots].astype(np.int64), 0)

    def document(self, ordinal: int) -> np.ndarray:
        return self.ids[self.offsets[ordinal] : self.offsets[ordinal + 1]]


class Encoder(PieceCoder):
    """A tokenizer file's ids for whole texts, by the tokenizers library.

    A text's pieces repeat; new ones are encoded side by side in long strings, as the pre-tokenizer
    splits between them anyway, and parted again by the tokens' lengths in bytes. Special tokens that
    stand in a text are found as the library does by default; encode_special splits them like other text.
    Texts with added tokens that may take or need what is beyond a piece are encoded whole.
    """

    def __init__(self, vocabulary: str, encode_special: bool = False):
        from tokenizers import Tokenizer

        super().__init__(ENCODED_PIECES)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = encode_special
        self.tokenizer.model._resize_cache(0)  # what is encoded twice stands in the tables here
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        names = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():  # a character of a byte-level token is a byte
            self.lengths[i] = len(name)
        beyond, added = [], []
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.lengths[i] = len(token.content.encode("utf-8"))
            added.append(re.escape(token.content))
            if not (token.special and encode_special) and (token.lstrip or token.rstrip or token.single_word or token.normalized or re.search(r"\s", token.content)):
                beyond.append(re.escape(token.content))
        self.beyond = re.compile("|".join(beyond)).search if beyond else None
        self.added = re.compile("|".join(added)).search if added else None

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        apart = {k for k, text in enumerate(texts) if self.beyond(text)} if self.beyond else ()
        found = super().encode_many([text for k, text in enumerate(texts) if k not in apart])
        for k, text in enumerate(texts):
            yield self._ids([text])[0] if k in apart else next(found)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cores(self, new: list[str]) -> list[tuple[str, str]]:
        found = cores(new)
        return [x for x in found if not self.added(x[0])] if self.added and self.added("\n".join(new)) else found

    def learn(self, new: list[str]) -> None:
        gc.disable()  # very many tuples, none in a cycle
        try:
            super().learn(new)
        finally:
            gc.enable()

    def ids_of(self, new: list[str]) -> Iterable[tuple[str, bytes]]:
        """Side by side where each starts with the blank that the pre-tokenizer splits before, else on lines of their own."""
        found: dict[str, bytes] = {"": b""}
        spaced = [p for p in new if p[:1] == " " and not p[-1].isspace()]
        bare = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        for some, between in ((spaced, ""), (bare, "\n")):
            for lo in range(0, len(some), ENCODED_TOGETHER):
                part = some[lo : lo + ENCODED_TOGETHER]
                ids = self._ids([between.join(part)])[0]
                data, gap = ids.tobytes(), len(between) * self.width
                size = np.cumsum([(len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass"))) + len(between) for p in part]) - len(between)
                ends = ((np.searchsorted(np.cumsum(self.lengths[ids]), size) + 1) * self.width).tolist()
                spans = map(slice, [0, *[e + gap for e in ends[:-1]]], ends)
                found.update(zip(part, map(data.__getitem__, spans), strict=True))
        apart = [p for p in new if p not in found]
        for lo in range(0, len(apart), ENCODED_TOGETHER):
            part = apart[lo : lo + ENCODED_TOGETHER]
            found.update((p, x.tobytes()) for p, x in zip(part, self._ids(part), strict=True))
        return found.items()


@functools.lru_cache(maxsize=2)
def encoder_of(vocabulary: str, encode_special: bool = False) -> Encoder:
    """Kept with its table for the next tasks of the same worker."""
    return Encoder(vocabulary, encode_special)


_MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())])


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else "file://" + folder)


def _writer(folder: str, vocabulary: str, end_id: int | None, shard_ids: int, encode_special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(vocabulary, encode_special)
        tail = np.array([] if end_id is None else [end_id], f"<u{encoder.width}")
        store, root = _store(folder)
        part, seq, keys, ids, held, nulls = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def close() -> pa.RecordBatch:
            path = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(path) as out:
                out.write(shard_bytes(np.array(keys, np.int64), ids, encoder.width))
            row = (path.rpartition("/")[2], part, seq, keys[0], keys[-1], len(keys), nulls, sum(map(len, ids)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _MANIFEST.types, strict=True)], schema=_MANIFEST)

        for some, texts in chunks(batches, CHUNK_CHARS // 2):
            for key, found in zip(some, encoder.encode_many(texts), strict=True):
                keys.append(NO_KEY if key is None else key)
                nulls += key is None
                ids.append(np.concatenate([found, tail]))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield close()
                    keys, ids, held, nulls, seq = [], [], 0, 0, seq + 1
        if keys:
            yield close()

    return run


def write_shards(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, encode_special: bool = False) -> tuple[str, DataFrame]:
    """Encode every text and write the shards; returns their folder and the manifest, in shared storage.

    Manifest: path (name in the folder), part (range of keys), first_key, last_key, n_docs, n_null (of
    them without an id, which come first), n_ids, first_id (ids of all shards before). A null text counts as empty, so that its document is the end id alone. A null id
    is kept under a key of its own, before all others. Documents of equal ids follow each other, over as many parts as they fill.
    A special token's name in a text gives its id, unless encode_special says that it is text like other.
    An empty table writes no shard. The running sums go over the parts first, then within each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or work_dir(spark, "token-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal and null ids, which may be very many, are dealt by their texts
    texts = texts.withColumn("_tie", F.xxhash64("text")).repartitionByRange(parts, "key", "_tie").sortWithinPartitions(F.col("key").asc_nulls_first(), "_tie").drop("_tie")
    schema = "path string, part long, seq long, first_key long, last_key long, n_docs long, n_null long, n_ids long"
    rows = staged(texts.mapInArrow(_writer(folder, vocabulary, end_id, shard_ids, encode_special), schema), "manifest")
    earlier = (Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # no more rows than the write has tasks
    starts = starts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("_start"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*earlier))
    return folder, rows.withColumn("_before", F.coalesce(within, F.lit(0))).join(F.broadcast(starts), "part").withColumn("first_id", F.col("_start") + F.col("_before")).drop("seq", "_start", "_before")


_FOUND = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, shard = None, None
        for batch in batches:
            names, first, nulls = batch.column("path"), batch.column("first_id").to_numpy(), batch.column("n_null").to_numpy()
            keys = batch.column("key").to_numpy()
            paths = names.dictionary_encode()
            codes = paths.indices.to_numpy()
            cuts = np.flatnonzero(np.diff(codes, prepend=-1))
            out: list[list] = [[], [], [], []]
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
                if names[lo].as_py() != name:
                    name = names[lo].as_py()
                    with store.open_input_file(f"{root}/{name}") as source:
                        shard = Shard(source.read())
                at, copies = shard.find(keys[lo:hi])
                for key, ordinal, n in zip(keys[lo:hi].tolist(), at.tolist(), copies.tolist(), strict=True):
                    for k in range(ordinal, ordinal + n):
                        ids = shard.document(k)
                        out[0].append(None if k < nulls[lo] else key)
                        out[1].append(int(first[lo]) + int(shard.offsets[k]))
                        out[2].append(len(ids))
                        out[3].append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=_FOUND)

    return run


def read_documents(folder: str, manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id", few_shards: int = 100_000) -> DataFrame:
    """Look keys up in the shards: one row per stored document of a key, with start, n_tokens and ids_crc32.

    start counts the ids of all documents before it. A key that no shard holds gives no row (but with
    a chance of 2 ** -32, when its fingerprint agrees). A key goes to the parts whose range holds it,
    which are broadcast, no more than the write had tasks; then to those of their shards whose range
    holds it, by a join with the manifest, broadcast if it is short (counted). Null asks for documents
    without an id, and so does the smallest long, whose documents are found with them.
    """
    spark = keys.sparkSession
    small_batches(spark)
    wanted = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_KEY)).alias("key")).distinct()
    bounds = manifest.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("first", "last", "part").toArrow()
    first, last, part = (bounds.column(c).to_numpy() for c in ("first", "last", "part"))
    ranges = spark.sparkContext.broadcast((first, np.maximum.accumulate(last) if len(last) else last, part))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, part = ranges.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            lo, hi = np.searchsorted(last, key, side="left"), np.searchsorted(first, key, side="right")
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)), pa.array(part[at])], names=["key", "part"])

    shards = hint(manifest.select("part", "path", "first_key", "last_key", "n_null", "first_id"), few_shards)
    placed = wanted.mapInArrow(places, "key long, part long").join(shards, "part").where("key BETWEEN first_key AND last_key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.select("path", "first_id", "n_null", "key").repartition(parts, "path").sortWithinPartitions("path")
    found = placed.mapInArrow(_reader(folder), "key long, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("key", id_col)
