"""Phrase collocation mining by direct-address tiles.

Words and phrases are counted per language. Only words that reach the least count can stand in a
phrase that does, so texts become rows of word ids once, and phrases grow word by word.

1. Words are counted; those that reach the least count are ranked by frequency, over all languages,
   so that an id tells language and word.
2. A phrase of k words is a pair: the rank of its first k - 1 words and the id of its last. Ranks and
   ids are addresses: the plane of pairs is cut into square tiles. In a chunk of text a tile with many
   occurrences is counted by bincount into a dense array, all other tiles by sorting their pairs
   (coordinate lists). Spark adds the counts of all chunks by pair.
3. Pairs that reach the least count are ranked by frequency anew, and are the first parts of the next
   length. An occurrence counts only if its first and its last k - 1 words are both frequent.

The ranked tables are broadcast, so their length is bounded: the most frequent ones fit, chosen by a
histogram of counts. Words and phrases beyond that bound are counted as strings, by an aggregation
over those occurrences alone that the tables can't address; a Bloom filter of the phrases left out
keeps rare ones away from it, and its errors only cost work. So nothing is left out at any size.

Scores are exact: products are decimals of up to 38 digits, which hold counts below 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import join_skewed, small_batches, staged

_SHIFT, _SIDE, _GRID = 20, 1024, 64
_BREAK = b"."
_BYTES = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_MARKS = 1 << 17


@dataclass(frozen=True)
class Mining:
    """least: occurrences of a candidate. share: per cent of its occurrences that a longer candidate needs to displace it.

    head_words, head_phrases: lengths of the broadcast tables. chunk: words counted at once. full: occurrences from which a tile is dense.
    """

    longest: int = 5
    least: int = 100
    share: int = 100
    top: int = 2000
    head_words: int = 500_000
    head_phrases: int = 2_000_000
    chunk: int = 1_000_000
    full: int = 1 << 17


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, and a full stop for each end of a piece."""
    return (text or b"").lower().translate(_BYTES).replace(_BREAK, b" . ").split()


@dataclass
class Level:
    """The addressable frequent phrases of one length: codes in ascending order with their frequency ranks, and codes by rank."""

    codes: np.ndarray
    ranks: np.ndarray
    by_rank: np.ndarray
    rest: np.ndarray | None = None  # Bloom filter of the others
    _tile: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray, rest: np.ndarray | None) -> Level:
        by_rank = codes[np.lexsort((codes, -counts))]
        order = np.argsort(by_rank)
        return cls(by_rank[order], order.astype(np.int32), by_rank, rest)

    def look_up(self, prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 for others: the first tile by address, the rest by binary search."""
        if self._tile is None:
            first = (self.codes >> _SHIFT < _SIDE) & (self.codes & (1 << _SHIFT) - 1 < _SIDE)
            own = self.codes[first]
            self._tile = np.full(_SIDE * _SIDE, -1, np.int32)
            self._tile[(own >> _SHIFT) * _SIDE + (own & (1 << _SHIFT) - 1)] = self.ranks[first]
        out = np.full(len(prefix), -1, np.int32)
        if not len(self.codes):
            return out
        near = (prefix < _SIDE) & (word < _SIDE)
        out[near] = self._tile[prefix[near].astype(np.int64) * _SIDE + word[near]]
        code = (prefix[~near].astype(np.int64) << _SHIFT) | word[~near]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        out[~near] = np.where(self.codes[at] == code, self.ranks[at], -1)
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tile": None}


def ranked(ids: np.ndarray, levels: list[Level]) -> Iterator[np.ndarray]:
    """For 1, 2, ... words: the rank of the phrase that starts at each place, -1 where it is not addressable."""
    rank = ids
    yield rank
    for k, level in enumerate(levels, 2):
        at = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0)) if len(rank) > 1 else np.empty(0, np.int64)
        longer = np.full(max(len(rank) - 1, 0), -1, np.int32)
        longer[at] = level.look_up(rank[at], ids[at + k - 1])
        rank = longer
        yield rank


def tile_counts(prefix: np.ndarray, word: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the pairs and their counts: full tiles by bincount, the others by sorting."""
    row, col = np.minimum(prefix // _SIDE, _GRID - 1), np.minimum(word // _SIDE, _GRID - 1)
    tile = row * _GRID + col
    fill = np.bincount(tile, minlength=_GRID * _GRID)
    codes, counts, rest = [], [], np.ones(len(prefix), bool)
    for t in np.flatnonzero(fill >= full).tolist():
        if t // _GRID == _GRID - 1 or t % _GRID == _GRID - 1:
            continue  # what lies beyond the grid
        own = tile == t
        rest &= ~own
        dense = np.bincount(prefix[own] % _SIDE * _SIDE + word[own] % _SIDE, minlength=_SIDE * _SIDE)
        some = np.flatnonzero(dense)
        codes.append((some // _SIDE + t // _GRID * _SIDE << _SHIFT) | (some % _SIDE + t % _GRID * _SIDE))
        counts.append(dense[some])
    some, n = np.unique((prefix[rest] << _SHIFT) | word[rest], return_counts=True)
    return np.concatenate([*codes, some]), np.concatenate([*counts, n])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts = batch.column("text").cast(pa.large_binary())
    for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
        yield lang, words_of(text.as_py())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), and n of all words of a language with a null word."""
    found: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, words in found.items() for word, n in words.items()]
        rows += [(lang, None, sum(words.values())) for lang, words in found.items()]
        found.clear()
        langs, words, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, words in _texts(batch):
            own = found.setdefault(lang, Counter())
            own.update(words)
            own.pop(_BREAK, None)
        if sum(map(len, found.values())) > 300_000:
            yield flush()
    yield flush()


def _vocabulary(head: list[tuple[str, bytes]]) -> dict[str, dict[bytes, int]]:
    out: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(head):
        out.setdefault(lang, {})[word] = i
    return out


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            rows = []
            for lang, words in _texts(batch):
                own = vocabulary.get(lang, {})
                ids = np.fromiter((own.get(w, -1) for w in words), np.int32, len(words))
                alone = ids < 0
                ids = ids[~(alone & np.concatenate([[True], alone[:-1]]))] if len(ids) else ids  # one of neighbouring breaks
                rows.append(ids)
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([lists], names=["ids"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """Ids of many rows in one array, a break after each row; a longer row is a chunk of its own."""
    held, n = [], 0
    for batch in batches:
        lists = batch.column("ids")
        ids, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).cumsum()
        held.append(np.insert(ids, ends, -1))
        n += len(held[-1])
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _count_phrases(shared, opts: Mining):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        k = len(levels) + 2
        for ids in _chunks(batches, opts.chunk):
            *_, rank = ranked(ids, levels)
            at = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0))
            codes, counts = tile_counts(rank[at].astype(np.int64), ids[at + k - 1].astype(np.int64), opts.full)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    return run


def _spell(shared):
    """(code, f) to (lang, phrase, f, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, levels = shared.value
        for batch in batches:
            code = batch.column("code").to_numpy()
            places = []
            for level in [*levels[::-1], None]:
                places.append(code & (1 << _SHIFT) - 1)
                code = code >> _SHIFT
                code = code if level is None else level.by_rank[code]
            ids = np.stack([code, *places[::-1]], axis=1).tolist()
            langs = [head[row[0]][0] for row in ids]
            phrases = [b" ".join(head[i][1] for i in row) for row in ids]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), batch.column("f"), batch.column("code")], names=["lang", "phrase", "f", "code"])

    return run


def bloom(phrases: DataFrame) -> np.ndarray:
    """Blocked Bloom filter of (lang, phrase): three bits of one of 2^17 64-bit blocks, which is all the driver gets."""
    h = F.xxhash64("lang", "phrase")

    def bit(by: int):
        return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {by}) & 63 as int))")

    blocks = phrases.select(h.alias("h")).select(F.expr(f"h & {_MARKS - 1}").alias("block"), bit(20).bitwiseOR(bit(30)).bitwiseOR(bit(40)).alias("bits"))
    found = blocks.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(_MARKS, np.int64)
    out[found.column("block").to_numpy()] = found.column("bits").to_numpy()
    return out


def passes(filter_: np.ndarray | None, lang: bytes, phrase: bytes) -> bool:
    if filter_ is None:
        return False
    h = xxhash.xxh64_intdigest(phrase, xxhash.xxh64_intdigest(lang, 42))
    bits = 1 << (h >> 20 & 63) | 1 << (h >> 30 & 63) | 1 << (h >> 40 & 63)
    return int(filter_[h & _MARKS - 1]) & bits == bits


def _count_rest(shared):
    """(lang, phrase, n) of the phrases that the ranked tables can't address and whose shorter parts may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rest, levels = shared.value
        vocabulary, k = _vocabulary(head), len(levels) + 2
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            langs, phrases = zip(*found, strict=True) if found else ((), ())
            out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "n"])
            found.clear()
            return out

        for batch in batches:
            for lang, words in _texts(batch):
                own, name = vocabulary.get(lang, {}), lang.encode()
                ids = np.fromiter((own.get(w, -1) for w in words), np.int32, len(words))
                maybe = np.array([i >= 0 or w != _BREAK and passes(rest, name, w) for i, w in zip(ids.tolist(), words, strict=True)], bool)
                for j, rank in enumerate(ranked(ids, levels), 1):
                    if j > 1:
                        both = maybe[:-1] & maybe[1:]
                        maybe = both & (rank >= 0)
                        for i in np.flatnonzero(both & ~maybe).tolist():
                            maybe[i] = passes(levels[j - 2].rest, name, b" ".join(words[i : i + j]))
                    if j == k - 1:
                        wanted = maybe[:-1] & maybe[1:] & ~((rank[:-1] >= 0) & (rank[1:] >= 0))
                        for i in np.flatnonzero(wanted).tolist():
                            found[lang, b" ".join(words[i : i + k])] += 1
                            if len(found) >= 200_000:
                                yield flush()
        yield flush()

    return run


def _head(found: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent rows with an address, at most so many, and whether these are all rows."""
    bucket = F.floor(F.log2("f") * 16)
    sizes = sorted(found.groupBy(bucket.alias("b"), F.col("code").isNotNull().alias("own")).count().collect(), reverse=True)
    total, floor = 0, 0
    for b, own, n in sizes:
        if own:
            total += n
            if total > most:
                floor = b + 1
                break
    chosen = found.where(F.col("code").isNotNull() & (bucket >= floor))
    return chosen, floor == 0 and all(own for _, own, _ in sizes)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", opts: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, phrase, k, f) of all phrases of 1 to ``longest`` words with at least ``least`` occurrences."""
    spark = docs.sparkSession
    small_batches(spark)
    share = spark.sparkContext.broadcast
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    words = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = staged(words.where((F.col("f") >= opts.least) | F.col("word").isNull()), "words")
    totals = words.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = words.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), "f", F.lit(0).cast("long").alias("code"))
    chosen, whole = _head(words, opts.head_words)
    rows = sorted(chosen.select("lang", "phrase", "f").collect(), key=lambda r: (-r.f, r.lang, r.phrase))
    head = [(r.lang, r.phrase.encode()) for r in rows]
    rest = None if whole else bloom(words.join(chosen, ["lang", "phrase"], "left_anti"))
    ids = staged(texts.mapInArrow(_encode(share(head)), "ids array<int>"), "ids")
    levels: list[Level] = []
    out = [words.select("lang", "phrase", F.lit(1).alias("k"), "f")]
    for k in range(2, opts.longest + 1):
        pairs = ids.mapInArrow(_count_phrases(share(levels), opts), "code long, n long")
        pairs = pairs.groupBy("code").agg(F.sum("n").alias("f")).where(F.col("f") >= opts.least)
        found = pairs.mapInArrow(_spell(share((head, levels))), "lang string, phrase string, f long, code long")
        if not whole:
            more = texts.mapInArrow(_count_rest(share((head, rest, levels))), "lang string, phrase string, n long")
            more = more.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= opts.least)
            found = found.unionByName(more.withColumn("code", F.lit(None).cast("long")))
        found = staged(found, f"phrases-{k}")
        out.append(found.select("lang", "phrase", F.lit(k).alias("k"), "f"))
        chosen, all_of_them = _head(found, opts.head_phrases)
        table = chosen.select("code", "f").toArrow()
        others = None if all_of_them else bloom(found.join(chosen, ["lang", "phrase"], "left_anti"))
        whole &= all_of_them
        levels.append(Level.of(table.column("code").to_numpy(), table.column("f").to_numpy(), others))
        if not len(table) and whole:
            break
    phrases = out[0]
    for more in out[1:]:
        phrases = phrases.unionByName(more)
    return totals, phrases


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", opts: Mining = Mining()) -> DataFrame:
    """Per language the best ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    Words are runs of other characters than blank and tab, in pieces between . , ; : ! ? and line
    ends, A-Z lower-cased. a, l, r: occurrences of the phrase and of its two parts at the cut with the
    lowest score, floor(1000 a n / (l r)), the first of equal ones; n: all words of the language. A
    candidate goes if a longer one that holds it has ``share`` per cent of its occurrences or more (one
    word longer is enough to look at, as counts fall with length). Ties by a, then by the phrase's bytes.
    A null lang is ``und``; a null or empty text has no words; rows count each, whatever else they
    hold; other columns are not read. An empty table gives an empty table.
    """
    totals, phrases = frequent_phrases(docs, text_col, lang_col, opts)
    words = F.split("phrase", " ")
    candidates = phrases.where("k > 1")
    longer = candidates.where("k > 2").withColumn("w", words)
    ends = F.array(F.expr("slice(w, 1, k - 1)"), F.expr("slice(w, 2, k - 1)"))
    longer = longer.select("lang", F.explode(F.transform(ends, lambda x: F.array_join(x, " "))).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * opts.share))
    cut = F.expr("explode(sequence(1, k - 1))").alias("cut")
    cuts = kept.select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"), cut)
    cuts = staged(cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("rest")), "cuts")
    for part, name in (("first", "l"), ("rest", "r")):
        # a part may stand in a large share of all phrases
        counted = cuts.groupBy("lang", F.col(part)).agg(F.count("*").alias("copies"))
        counted = staged(counted.join(phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part]), "parts")
        cuts = staged(join_skewed(cuts, counted, ["lang", part], "copies"), "counted")
    n = F.broadcast(totals) if totals.count() <= 100_000 else totals
    cuts = cuts.join(n, "lang")
    score = F.expr("(cast(a as decimal(15,0)) * 1000 * cast(n as decimal(16,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= opts.top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= opts.top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
