"""Operators over documents against brute force, with edge cases in one table."""

import base64
import collections
import hashlib
import random
import re
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from ridgeline.llm.bpe import Bpe, digests, encode_decode, pieces
from ridgeline.llm.decontaminate import FMIndex, Search, contamination, report, without_spans
from ridgeline.llm.ngram_join import Rule, _mixed, _tile_clusters, ngram_jaccard_join, tiles_of
from ridgeline.llm.shuffle_shards import Shuffle, _hypergeometric, communication_matrix, permuted, shuffle_into_shards
from ridgeline.llm.token_files import Encoder, PerfectHash, Shard, read_documents, shard_bytes, write_shards

RANKS, JSON = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
CODERS = Encoder(JSON), Bpe.load(RANKS, public_tokenizers.PATTERN)
LIBRARY_JSON = Tokenizer.from_file(JSON)
LIBRARY_RANKS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODERS[1].ranks, special_tokens={})
SCHEMA = "doc_id long, text string, shard string, slot int, id int, spans string, entities int"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "été", "x1", "don't", "…"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "   \n\t ", "one two", "one two", "ONE two", base, base, " ".join(near), base + " tail", words(rng, 50), words(rng, 3000), "\x00a\x1cb\xa0 c  d", "🙂 日本語 ½ Ⅷ", base.upper()]
    found = [(i, t) for i, t in enumerate(texts)]
    found += [(6, base), (3, words(rng, 60)), (None, base), (-5, "\n".join([base] * 3)), (100, " " * 5000 + "end"), (101, "a" * 20000)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 7, "p", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("rule", [Rule(), Rule(n=5, num=80, den=100), Rule(tile_rows=2, tile_bytes=2000), Rule(node_bits=2)])
def test_ngram_join(spark, docs, rows, rule):
    sets = [(i, shingle_set(t, rule.n)) for i, t in rows]
    comp = {i: i for i, _ in sets if i is not None}
    known = [(i, s) for i, s in sets if i is not None and s]
    graph = collections.defaultdict(set)
    for a, (i, s) in enumerate(known):
        for b, (j, t) in enumerate(known):
            if a != b and rule.den * len(s & t) >= rule.num * len(s | t):
                graph[a].add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in graph[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return min(known[b][0] for b in seen)

    want = collections.Counter((i, len(s), comp[i] if not s else None) for i, s in sets if i is not None and not s)
    want.update((i, len(s), reach(a)) for a, (i, s) in enumerate(known))
    want.update((None, len(s), None) for i, s in sets if i is None)
    assert collections.Counter(map(tuple, ngram_jaccard_join(docs, rule=rule).collect())) == want


@pytest.mark.parametrize("rule", [Rule(), Rule(n=5, num=80, den=100), Rule(num=1, den=2), Rule(num=99, den=100)])
def test_linked_sets_share_a_tile(rule):
    """Sets right at the threshold, of every size and however they differ."""
    rng, checked = np.random.default_rng(rule.num), 0
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(12):
            common = draw(size)
            most = size * (rule.den - rule.num) // rule.num  # n-grams that only one of the two may hold
            left = int(rng.integers(0, most + 1))
            a, b = (np.unique(np.concatenate([common, draw(k)])) for k in (left, most - left))
            both = len(np.intersect1d(a, b))
            assert rule.den * both >= rule.num * (len(a) + len(b) - both)
            tiles = [{*np.concatenate(tiles_of(s, rule)).tolist()} for s in (a, b)]
            assert tiles[0] & tiles[1]
            checked += most > 0
    assert checked


def test_tiles_in_which_clusters_meet():
    """However the rows fall into batches; 0 stands for nodes without a cluster."""
    rng = random.Random(12)
    for _ in range(300):
        rows = [(rng.randint(-4, 4), rng.choice([0, 1, 1, 1, 2])) for _ in range(rng.randint(0, 30))]
        lists = [[t for t, c in rows if c == k] for k in (0, 1, 2)]
        batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), pa.array([0, 1, 2], pa.int64())], names=["tiles", "cluster"])
        pairs = sorted((t, c) for b in _tile_clusters(iter([batch])) for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        assert collections.Counter(pairs) == collections.Counter({p: n if p[1] == 0 else 1 for p, n in collections.Counter(rows).items()})
        cuts = sorted(rng.randint(0, len(pairs)) for _ in range(3))
        parts = [pairs[a:b] for a, b in zip([0, *cuts], [*cuts, len(pairs)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in p], pa.int64()), pa.array([c for _, c in p], pa.int64())], names=["tile", "cluster"]) for p in parts]
        found = [t for b in _mixed(iter(batches)) for t in b.column(0).to_pylist()]
        held = collections.defaultdict(list)
        for t, c in pairs:
            held[t].append(c)
        assert found == sorted(t for t, cs in held.items() if len(cs) > 1 and (0 in cs or len(set(cs)) > 1))


def test_ngram_join_empty(empty):
    assert ngram_jaccard_join(empty).count() == 0


def test_hot_hashes_meet(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts = []
    for k in range(40):
        w = list(base)
        w[rng.randrange(300)] = f"z{k}"
        texts.append((k, " ".join(w)))
    found = ngram_jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"), rule=Rule(tile_rows=8))
    assert {r.component_id for r in found.collect()} == {0}


def test_fm_index():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 50))]
        index = FMIndex(np.array(s), 4)
        for p in ([rng.randint(1, 4) for _ in range(rng.randint(1, 4))] for _ in range(5)):
            lo, hi = index.intervals(np.array([p]))
            at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if hi[0] > lo[0] else []
            assert at == [i for i in range(len(s) - len(p) + 1) if s[i : i + len(p)] == p]


def test_contamination(spark, docs, rows):
    rng = random.Random(4)
    base = words(rng, 120)
    items = [(2, " ".join(base.split()[10:40])), (10, "one TWO"), (11, "…"), (12, None), (13, "日本語 ½ Ⅷ"), (3, "never seen words")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = []
    for i, t in rows:
        w, hit, seen = low(t), set(), set()
        for item, text in items:
            p = low(text)
            k = min(10, len(p))
            for j in range(len(p) - k + 1 if k else 0):
                for a in range(len(w) - k + 1):
                    if w[a : a + k] == p[j : j + k]:
                        hit |= set(range(a, a + k))
                        seen.add(str(item))
        want.append((i, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    found = contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert collections.Counter(map(tuple, report(found).collect())) == collections.Counter(want)
    for r in found.where("doc_id = 9").collect():
        text = dict(rows)[9]
        left = without_spans(text, [(s.start, s.end) for s in r.spans])
        gone = {p for s in r.spans for p in range(s.start, s.end)}
        assert low(left) == [w for p, w in enumerate(low(text)) if p not in gone]


def test_contamination_in_blocks(spark, docs):
    """As many blocks as items; repeated and null ids stand in documents, null ids also in the benchmark."""
    rng = random.Random(4)
    base = words(rng, 120)
    items = [(2, " ".join(base.split()[10:40])), (10, "one TWO"), (10, "two"), (13, "日本語 ½ Ⅷ"), (None, " ".join(base.split()[60:75])), (None, "three")]
    items = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda t: sorted(map(repr, t.collect()))
    whole = contamination(docs, items)
    parts = contamination(docs, items, opts=Search(block_windows=1))
    assert plain(parts) == plain(whole) and plain(report(parts)) == plain(report(whole)) and whole.count() == docs.count()
    by_null = report(contamination(docs, items.where("item_id IS NULL")))
    assert {r.doc_id for r in by_null.where("n_hit > 0").collect()} >= {6, 9, None}
    assert {r.n_items for r in by_null.where("n_hit > 0").collect()} == {1}


def test_contamination_empty(spark, docs, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty, items).count() == 0
    assert report(contamination(docs, items)).where("contaminated").count() == 0


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


def test_byte_bpe(docs, rows):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert collections.Counter(map(tuple, digests(docs, RANKS, public_tokenizers.PATTERN).collect())) == collections.Counter(want)
    full = encode_decode(docs, RANKS, public_tokenizers.PATTERN).where("doc_id = 13").first()
    assert full.ids == library.encode_ordinary(rows[13][1]) and bytes(full.decoded) == rows[13][1].encode()


def test_byte_bpe_any_ranks():
    """Also where a merge makes a pair of a smaller rank."""
    rng = random.Random(5)
    for trial in range(60):
        tokens = {bytes([b]) for b in range(256)} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(40)}
        order = sorted(tokens)
        rng.shuffle(order)
        own = {t: i for i, t in enumerate(order)}
        library = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks=own, special_tokens={})
        coder = Bpe(own, r"\S+|\s+")
        for _ in range(20):
            text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
            ids = coder.merge([m.encode() for m in coder.matches(text)]) if text else np.array([])
            assert ids[ids >= 0].tolist() == library.encode_ordinary(text)


def test_pieces():
    for text in ("", " ", "a b", "  a  b ", "a \n b\x00c d", " x", "a.\nb,", "\n", "a\n\nb"):
        assert "".join(pieces(text)) == text
    assert pieces("So it is.\nAnd so.") == ["So", " it", " is.", "\n", "And", " so."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", ",", ".", "'", "!", "a", "the", "B", "é", "1", "中", "\u00a0", "'s", "'ll", "<|endoftext|>", "<|", "_", "ʼ", "\0", "ª", "²", "😀"]), max_size=30))
def test_pieces_encode_as_whole_texts(parts):
    """Both coders against their libraries, wherever blanks, line ends, punctuation and special tokens meet."""
    text = "".join(parts)
    assert CODERS[0].encode(text).tolist() == LIBRARY_JSON.encode(text, add_special_tokens=False).ids
    ids = CODERS[1].encode(text)
    assert ids.tolist() == LIBRARY_RANKS.encode_ordinary(text) and CODERS[1].decode(ids) == text.encode()


def test_long_match_alone():
    """A match whose merges make pairs of smaller ranks takes time in proportion, not in its square."""
    own = [b"ab", b"abab", b"abababab", *(bytes([b]) for b in range(256))]
    coder = Bpe({t: i for i, t in enumerate(own)}, r"\S+|\s+")
    began = time.perf_counter()
    ids = coder.merge_alone(b"ab" * 100_000)
    assert time.perf_counter() - began < 20 and len(ids) == 25_000


def test_token_files_of_extreme_keys(spark):
    docs = spark.createDataFrame([(None, "a"), (-(1 << 63), "b c"), (None, ""), (3, "d"), (3, "d"), ((1 << 63) - 1, None)], "doc_id long, text string")
    folder, manifest = write_shards(docs, JSON, shard_ids=3)
    found = read_documents(folder, manifest, docs).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in found) == collections.Counter({(None, 2): 1, (None, 1): 1, (-(1 << 63), 3): 1, (3, 2): 2, ((1 << 63) - 1, 1): 1})
    assert sorted(r.start for r in found) == [0, *np.cumsum([n for _, n in sorted((r.start, r.n_tokens) for r in found)])[:-1].tolist()]


def test_token_files_of_one_id(spark):
    """A third of the rows without an id and a third under one id lie in several parts, and all are found."""
    docs = spark.createDataFrame([((None, 5, i)[i % 3], f"text {i}") for i in range(600)], "doc_id long, text string")
    folder, manifest = write_shards(docs, JSON, shard_ids=100)
    assert manifest.where("n_null > 0").select("part").distinct().count() > 1 or manifest.where("first_key <= 5 AND last_key >= 5").select("part").distinct().count() > 1
    found = read_documents(folder, manifest, docs).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter({None: 200, 5: 200} | {i: 1 for i in range(2, 600, 3) if i != 5} | {5: 201})
    n = sorted((r.start, r.n_tokens) for r in found)
    assert [s for s, _ in n] == [0, *np.cumsum([k for _, k in n])[:-1].tolist()]


def test_token_files(spark, docs, rows, empty):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    folder, manifest = write_shards(docs, JSON, shard_ids=2000)
    assert manifest.count() > 1
    found = read_documents(folder, manifest, docs).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    by_key = sorted((r.start, r.doc_id if r.doc_id is not None else float("-inf")) for r in found)
    assert [k for _, k in by_key] == sorted(k for _, k in by_key)
    strange = spark.createDataFrame([(10**15 + i,) for i in range(50)], "doc_id long")
    assert read_documents(folder, manifest, strange).count() == 0
    folder, manifest = write_shards(empty, JSON)
    assert read_documents(folder, manifest, docs).count() == 0


def test_special_tokens_in_texts(spark, tmp_path):
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"x{end}y", f"a  {end}  b", f"\n {end}\n b", f"{end}{end} {end}", f" {end} a" * 40, "<|endo ftext|> <|end oftext|>", f"plain text <|endoftext {end}"]
    plain, split = Tokenizer.from_file(JSON), Tokenizer.from_file(JSON)
    split.encode_special_tokens = True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tokenizer, options in ((plain, {}), (split, {"encode_special": True})):
        folder, manifest = write_shards(docs, JSON, **options)
        start, found = 0, {r.doc_id: r for r in read_documents(folder, manifest, docs).collect()}
        for i, t in enumerate(texts):
            ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
            assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    plain.add_special_tokens([AddedToken("<é>", rstrip=True), AddedToken("<of us>"), AddedToken("<w>", single_word=True)])
    plain.save(f"{tmp_path}/more.json")
    texts += ["a <é>  b", "x <of us> y", "one<w> <w> two", "<é> <é>"]
    for t, ids in zip(texts, Encoder(f"{tmp_path}/more.json").encode_many(texts), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids


def test_token_table_is_bounded():
    """What an encoder keeps of pieces that never come again doesn't grow with the texts, and ids stay right."""
    coder, held = Encoder(JSON), 0
    for lo in range(0, 800_000, 50_000):
        text = " ".join(f"{i:x}" for i in range(lo, lo + 50_000))
        ids = coder.encode(text)
        held = max(held, sys.getsizeof(coder.table) + sum(sys.getsizeof(p) + sys.getsizeof(x) for p, x in coder.table.items()))
    assert held < 90e6
    assert ids.tolist() == LIBRARY_JSON.encode(text, add_special_tokens=False).ids


def test_perfect_hash():
    for n in (1, 2, 3, 50, 1000):
        keys = np.unique(np.random.default_rng(n).integers(-(10**15), 10**15, n))
        assert sorted(PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))
    shard = Shard(shard_bytes(np.array([1, 1, 5]), [np.array([7]), np.array([8, 9]), np.array([], int)], 2))
    at, copies = shard.find(np.array([1, 5, 6]))
    assert at.tolist() == [0, 2, -1] and copies.tolist() == [2, 1, 0] and shard.document(1).tolist() == [8, 9]


def test_shuffle(spark, docs, rows, empty):
    found = shuffle_into_shards(docs)
    assert found.columns == [*docs.columns, "_shard", "_slot"]
    got = found.collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r._shard].append(r._slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) <= 1
    assert shuffle_into_shards(empty).count() == 0


def test_shuffle_of_many_files(spark, tmp_path):
    """More files than origins, one of them longer than an origin and one empty."""
    path = f"{tmp_path}/many"
    for lo, hi, files in ((0, 200, 12), (200, 260, 1), (260, 260, 1)):
        spark.range(lo, hi).repartition(files).write.mode("append").parquet(path)
    opts = Shuffle(shards=7, origin_rows=16, max_origins=4)
    runs = []
    for _ in range(2):
        runs.append(sorted((r.shard, r.slot, r.id) for r in shuffle_into_shards(spark.read.parquet(path), opts, scan=True).collect()))
    assert runs[0] == runs[1] and sorted(i for _, _, i in runs[0]) == list(range(260))
    sizes = collections.Counter(s for s, _, _ in runs[0])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    assert [(s, k) for s, k, _ in runs[0]] == [(s, k) for s in range(7) for k in range(sizes[s])]


def test_shuffle_is_uniform(spark, tmp_path):
    """Shards of many rows from several origins: every row is as likely in every shard and slot as any other."""
    path = f"{tmp_path}/rows"
    for lo in (0, 300, 900):
        spark.range(lo, {0: 300, 300: 900, 900: 1200}[lo]).coalesce(1).write.mode("append").parquet(path)
    table, shard_of, slot_of = spark.read.parquet(path), np.zeros((24, 1200), int), np.zeros((24, 1200), int)
    for seed in range(24):
        for r in shuffle_into_shards(table, Shuffle(shards=4, seed=seed, origin_rows=256), scan=True).collect():
            shard_of[seed, r.id], slot_of[seed, r.id] = r.shard, r.slot
    assert all((np.bincount(s, minlength=4) == 300).all() for s in shard_of)
    assert all(sorted(slot_of[k][shard_of[k] == s]) == list(range(300)) for k in range(24) for s in range(4))
    for part in (slice(0, 300), slice(300, 900), slice(900, 1200)):  # each file's rows, over shards and over the quarters of a shard
        for seen, cells in ((shard_of[:, part], 4), (slot_of[:, part] // 75, 4)):
            n = np.bincount(seen.ravel(), minlength=cells)
            assert ((n - n.mean()) ** 2 / n.mean()).sum() < 25
    same = (shard_of[:, :-1] == shard_of[:, 1:]).mean()  # neighbours part as strangers do
    assert abs(same - 299 / 1199) < 0.01
    near = np.abs(slot_of[:, :-1] - slot_of[:, 1:])[shard_of[:, :-1] == shard_of[:, 1:]]
    assert abs(near.mean() - 301 / 3) < 4


def test_hypergeometric_beyond_the_generator():
    """Both ways of drawing have the distribution's mean and variance."""
    rng = np.random.default_rng(8)
    for good, bad, n in ((3 * 10**9, 10**9, 4000), (2 * 10**9, 6 * 10**9, 10**9)):
        draws = np.array([_hypergeometric(rng, good, bad, n) for _ in range(3000)], float)
        share, total = good / (good + bad), good + bad
        spread = np.sqrt(n * share * (1 - share) * (total - n) / (total - 1))
        assert abs(draws.mean() - n * share) < 5 * spread / np.sqrt(3000) and abs(draws.std() / spread - 1) < 0.06


def test_communication_matrix():
    counts = np.array([10, 0, 1000, 3])
    m = communication_matrix(counts, 7, 1)
    assert (m.sum(axis=1) == counts).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    draws = np.array([communication_matrix(np.array([50, 50]), 2, s)[0, 0] for s in range(2000)])
    assert abs(draws.mean() - 25) < 0.3 and abs(draws.var() - 50 * 0.25 * 50 / 99) < 0.8
    for n in (1, 5, 64, 1000):
        assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, 3)).tolist()) == list(range(n))
