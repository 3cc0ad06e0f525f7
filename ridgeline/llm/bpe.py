"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The ranks come from a rank file (base64 token, rank per line); the text is split by the vocabulary's
pattern and each match is merged on its own. The pending merges of a match wait in buckets, one per
rank, that hold positions of a linked list; a three-level bitmap over the ranks finds the next
non-empty bucket by find-first-set, and an entry whose pair has changed meanwhile is skipped. A
match of n bytes takes O(n log n) at worst (a bucket is sorted when it is opened), also when it is
megabytes long.

A text is first cut before every blank that follows a non-blank: no match of the pattern crosses
such a cut, and what stands before it doesn't change what matches after it. These pieces repeat, so
their ids are kept in a bounded table, and the new pieces of many texts are merged side by side in
one queue: each opened bucket then serves all of them.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import operator
import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import runs, small_batches

_DOUBLE_BLANK = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= )")
KEPT_PIECES = 250_000
#: Pieces that a worker keeps between its tasks.
RESTING_PIECES = 30_000
LONG_PIECE = 64
MERGED_TOGETHER = 60_000
CHUNK_CHARS = 4 << 20


def pieces(text: str) -> list[str]:
    """The text cut before each blank that follows a non-blank, and around lone line ends; no match of the pattern crosses a cut."""
    if "\0" in text or _DOUBLE_BLANK.search(text):
        return _CUT.split(text) if text else []
    # every white space stands alone here: a line end is a match of its own, a blank starts one
    return list(filter(None, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


def cores(new: list[str]) -> list[tuple[str, str]]:
    """(piece, core) of those whose punctuation at the end is a match of its own."""
    found = zip(new, [p.rstrip(string.punctuation) for p in new], strict=True)
    return [(p, c) for p, c in found if p != c and c and c[-1] < "\u0250" and c[-1].isalpha()]


class PieceCoder:
    """Token ids of texts by a bounded table of the ids of their pieces and the pieces' cores.

    An entry longer than LONG_PIECE is forgotten after its chunk, so that ``kept`` bounds bytes, too.
    """

    kind = "<u4"

    def __init__(self, kept: int = KEPT_PIECES) -> None:
        self.kept = kept
        self.table: dict[str, bytes] = {}
        self.passing: list[str] = []

    def ids_of(self, new: list[str]) -> Iterable[tuple[str, bytes]]:
        """Strings that no match crosses the ends of, in any order, with their ids."""
        raise NotImplementedError

    def cores(self, new: list[str]) -> list[tuple[str, str]]:
        return cores(new)

    def learn(self, new: list[str]) -> None:
        pairs = self.cores(new)
        parts = set(new).difference([p for p, _ in pairs])
        parts.update([c for _, c in pairs], [p[len(c) :] for p, c in pairs])
        todo = list(parts.difference(self.table))
        for lo in range(0, len(todo), MERGED_TOGETHER):
            self.table.update(self.ids_of(todo[lo : lo + MERGED_TOGETHER]))
        self.table.update([(p, self.table[c] + self.table[p[len(c) :]]) for p, c in pairs])
        self.passing = [p for p in itertools.chain(todo, new) if len(p) > LONG_PIECE]

    def forget(self) -> None:
        for p in self.passing:
            self.table.pop(p, None)
        self.passing = []
        if len(self.table) > self.kept:  # those met first are mostly the frequent ones
            self.table = dict(itertools.islice(self.table.items(), self.kept // 2))

    def rest(self) -> None:
        """After a task: a worker, which may go on to other work, keeps the pieces met first alone."""
        self.forget()
        self.table = dict(itertools.islice(self.table.items(), RESTING_PIECES))

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text; all of the texts' pieces are held at a time."""
        self.forget()
        cut = [pieces(text) for text in texts]
        self.learn(list(set().union(*cut).difference(self.table)))
        look = self.table.__getitem__
        for some in cut:
            yield np.frombuffer(b"".join(map(look, some)), self.kind)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))


class RankQueue:
    """Positions by rank; first() is the smallest rank that has any."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        self.mark(rank)

    def mark(self, rank: int) -> None:
        """The rank's bucket has positions."""
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions with ranks of their own; those with a negative rank stay out."""
        some = np.flatnonzero(ranks >= 0)
        some = some[np.argsort(ranks[some], kind="stable")]
        ranks, positions = ranks[some], positions[some]
        for lo, hi in runs(ranks):
            self.push(int(ranks[lo]), positions[lo:hi])

    def first(self) -> int:
        if not self.top:
            return -1
        i = (self.top & -self.top).bit_length() - 1
        word = self.mid[i]
        i = i << 6 | (word & -word).bit_length() - 1
        word = self.low[i]
        return i << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> np.ndarray:
        """The rank's positions in ascending order; they leave the queue."""
        self.clear(rank)
        bucket = self.buckets.pop(rank)
        return np.unique(bucket[0] if len(bucket) == 1 else np.concatenate(bucket))

    def clear(self, rank: int) -> None:
        """The rank's bucket is empty."""
        i, j = rank >> 6, rank >> 12
        self.low[i] &= ~(1 << (rank & 63))
        if not self.low[i]:
            self.mid[j] &= ~(1 << (i & 63))
            if not self.mid[j]:
                self.top &= ~(1 << j)


class _Pairs(dict):
    """Rank of the token that tokens a and b make, or -1, by a << 20 | b."""

    def __init__(self, ranks: dict[bytes, int], tokens: list[bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, key: int) -> int:
        if len(self) > 250_000:
            self.clear()
        rank = self[key] = self.ranks.get(self.tokens[key >> 20] + self.tokens[key & 0xFFFFF], -1)
        return rank


class Bpe(PieceCoder):
    """Encoder and decoder over a rank file's content."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        blank = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.matches = regex.compile(blank).findall
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.pairs = _Pairs(ranks, self.tokens)
        self.pair = self.pairs.__getitem__
        self.queue = RankQueue(size)
        self.decoding = _Gather(self.tokens)

    def rest(self) -> None:
        super().rest()
        self.pairs.clear()

    @classmethod
    @functools.lru_cache(maxsize=1)
    def load(cls, path: str, pattern: str) -> Bpe:
        """Kept with some of its table for the next tasks of the same worker."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}, pattern)

    def merge(self, matches: list[bytes]) -> np.ndarray:
        """All matches side by side in one linked list that no pair crosses: ids by byte position, -1 where merged away."""
        data = np.frombuffer(b"".join(matches), np.uint8)
        n = len(data)
        ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        starts = np.concatenate([[0], ends[:-1]])
        after, before, ids = np.arange(1, n + 1), np.arange(-1, n - 1), self.byte[data]
        after[ends - 1] = n
        before[starts] = -1
        rank_at = np.full(n, -1, np.int64)  # of the pair that starts here
        rank_at[:-1] = self.byte_pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank_at[ends - 1] = -1
        for k, whole in enumerate(map(self.ranks.get, matches)):
            if whole is not None:
                ids[starts[k] : ends[k]], rank_at[starts[k] : ends[k]] = -1, -1
                ids[starts[k]] = whole
        queue, again = self.queue, []
        queue.push_all(rank_at, np.arange(n))
        while (rank := queue.first()) >= 0:
            i = queue.take(rank)
            i = i[rank_at[i] == rank]  # else stale
            j = after[i]
            if len(i) > 1 and (touch := i[1:] == j[:-1]).any():  # of overlapping pairs every other, from the left
                place = np.arange(len(i))
                start = np.maximum.accumulate(np.where(np.concatenate([[True], ~touch]), place, 0))
                i = i[(place - start) % 2 == 0]
                j = after[i]
            if not len(i):
                continue
            k = after[j]
            if (close := i[1:] == k[:-1]).any():  # the left one's merge comes first and may pair with what the right one takes
                early = self.pair_ranks(rank << 20 | ids[i[1:][close]])
                again.append(i[1:][close][(early >= 0) & (early < rank)])
            ids[i], ids[j], rank_at[j] = rank, -1, -1
            after[i] = k
            rank_at[i] = -1
            followed = k < n
            at, k = i[followed], k[followed]
            before[k] = at
            rank_at[at] = right = self.pair_ranks(rank << 20 | ids[k])
            h = before[i]
            h = h[h >= 0]
            rank_at[h] = left = self.pair_ranks(ids[h] << 20 | rank)
            queue.push_all(right, at)
            queue.push_all(left, h)
            if (early := (right >= 0) & (right < rank)).any():
                again.append(at[early])
            if (early := (left >= 0) & (left < rank)).any():
                again.append(h[early])
        for k in np.unique(np.searchsorted(ends, np.concatenate(again), side="right")).tolist() if again else []:
            alone = self.merge_alone(matches[k])  # its order of merges may have mattered
            ids[starts[k] : ends[k]] = -1
            ids[starts[k] : starts[k] + len(alone)] = alone
        return ids

    def pair_ranks(self, keys: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.pair, keys.tolist()), np.int64, len(keys))

    def merge_alone(self, match: bytes) -> list[int]:
        """One match, one merge at a time: needed where a merge makes a pair of a smaller rank."""
        ids = self.byte[np.frombuffer(match, np.uint8)].tolist()
        n, queue = len(ids), self.queue
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}  # heaps of positions

        def put(i: int) -> None:
            if i >= 0 and after[i] < n and (rank := self.pair(ids[i] << 20 | ids[after[i]])) >= 0:
                if rank not in buckets:
                    buckets[rank] = []
                    queue.mark(rank)
                heapq.heappush(buckets[rank], i)

        for i in range(n - 1):
            put(i)
        while (rank := queue.first()) >= 0:
            i = heapq.heappop(buckets[rank])
            if not buckets[rank]:
                del buckets[rank]
                queue.clear(rank)
            j = after[i]
            if ids[i] < 0 or j == n or self.pair(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(i)
            put(before[i])
        return [x for x in ids if x >= 0]

    def ids_of(self, new: list[str]) -> Iterable[tuple[str, bytes]]:
        one = [p for p in new if p[p[:1] == " " :].isalpha() and max(p) < "\u0250"]  # each a match as it is
        others = list(set(new).difference(one))
        found = list(map(self.matches, others))
        distinct = list(dict.fromkeys(itertools.chain(one, *found)))
        ids = dict(zip(distinct, self._sliced(self.merge([m.encode("utf-8", "surrogatepass") for m in distinct]), distinct), strict=True))
        ids.update([(p, b"".join(map(ids.__getitem__, some))) for p, some in zip(others, found, strict=True)])
        return ids.items()

    @staticmethod
    def _sliced(ids: np.ndarray, matches: list[str]) -> list[bytes]:
        live = ids >= 0
        tokens = ids[live].astype("<u4").tobytes()
        ends = np.cumsum([len(m.encode("utf-8", "surrogatepass")) for m in matches])
        ends = (np.concatenate([[0], np.cumsum(live)])[ends] * 4).tolist()
        return [tokens[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decoding(ids)


class _Gather:
    """Concatenate byte strings by number, all at once."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings) or b"\0", np.uint8)
        self.lengths = np.array([len(s) for s in strings], np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, ids: np.ndarray, step: int = 1 << 18) -> bytes:
        out = []
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.blob[np.repeat((self.starts[part] - ends + n).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)].tobytes())
        return b"".join(out)


def chunks(batches: Iterator[pa.RecordBatch], chars: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of several rows, until they hold so many characters; a null text is empty."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(text or "")
            held += len(texts[-1]) + 50
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _coder(vocabulary: str, pattern: str, schema: pa.Schema, rows: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(vocabulary, pattern)
        emit = rows(bpe)
        for ids, texts in chunks(batches, CHUNK_CHARS // 2):
            found = [emit(x) for x in bpe.encode_many(texts)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], schema=schema)
        bpe.rest()

    return run


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ids (the text's token ids) and decoded (the bytes that the ids stand for).

    A null text counts as empty: no ids, no bytes. Null and repeated ids keep their rows; other
    columns are ignored. The vocabulary is a path that every executor can open.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    run = _coder(vocabulary, pattern, schema, lambda bpe: lambda ids: (ids.astype(np.int32), bpe.decode(ids)))
    found = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, ids array<int>, decoded binary")
    return found.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of what encode_decode() gives, taken in the same task."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(bpe: Bpe):
        decimal = _Gather([b"%d " % i for i in range(len(bpe.tokens))])

        def emit(ids: np.ndarray) -> tuple:
            return len(ids), hashlib.sha256(decimal(ids)[:-1]).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

        return emit

    run = _coder(vocabulary, pattern, schema, rows)
    found = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)
