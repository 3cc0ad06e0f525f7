"""Collocations, vector codes and vantage-point trees against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from ridgeline.llm import collocations as col
from ridgeline.llm import vantage_trees as vp
from ridgeline.llm import vector_codes as vc

SCHEMA = "doc_id long, lang string, text string, phrase long"


def counted(rows, longest=5):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, lang, text, _ in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][" ".join(words[i : i + k])] += 1
    return n, f


def best_phrases(rows, opts):
    n, counts = counted(rows, opts.longest)
    out = []
    for lang, f in counts.items():
        fit = {p: a for p, a in f.items() if a >= opts.least and " " in p}
        found = []
        for p, a in fit.items():
            if any(q != p and f" {p} " in f" {q} " and 100 * b >= opts.share * a for q, b in fit.items()):
                continue
            w = p.split(" ")
            cuts = [(1000 * a * n[lang] // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, p.encode(), (p, a, left, right, n[lang], score)))
        out += [(lang, i, *x[-1]) for i, x in enumerate(sorted(found)[: opts.top], 1)]
    return sorted(out)


def babble(rng, n):
    words = [f"{a}{b}" for a in ("ka", "Lo", "mi", "né", "东") for b in ("t", "s", "", "x")] + ["o'z", "3", " ", "x-y"]
    set_phrases = ["Kat lo s mi t", "ka\tka ka", "mi mi mi mi mi mi", "3 o'z 3"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(set_phrases if rng.random() < 0.4 else words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", "?", "\x0b", " \x1c "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.randint(0, 30), rng.choice(["en", "de", "de", None]), text, i))
    return [*rows, (1, "en", None, 1), (None, None, "", 1), (5, "xx", "a " * 30_000, 1), rows[0], rows[0]]


@pytest.mark.parametrize(
    "opts",
    [
        col.Mining(least=12, top=40),
        col.Mining(least=12, top=40, share=60, chunk=500, full=50),
        col.Mining(least=12, top=10_000, head_words=6, head_phrases=4, chunk=700),
        col.Mining(least=12, top=10_000, head_words=100, head_phrases=3),
        col.Mining(least=2, top=10_000, head_words=1, head_phrases=1),
    ],
)
def test_collocations(spark, opts):
    rows = babble(random.Random(5), 150)
    found = col.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), opts=opts)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got, want = sorted(map(tuple, found.collect())), best_phrases(rows, opts)
    assert len(want) > 20 and got == want


def test_phrases_beyond_the_tables_pass_their_filter(spark):
    rows = babble(random.Random(6), 60)
    n, f = counted(rows)
    phrases = [(lang, p) for lang, own in f.items() for p in own][:3000]
    marks = col.bloom(spark.createDataFrame(phrases, "lang string, phrase string"))
    assert all(col.passes(marks, lang.encode(), p.encode()) for lang, p in phrases)
    assert sum(col.passes(marks, b"en", f"not {i}".encode()) for i in range(2000)) < 100


def test_tiles_count_every_pair():
    rng = np.random.default_rng(3)
    a, b = (np.concatenate([rng.integers(0, 40, 5000), rng.integers(0, 90_000, 3000)]) for _ in range(2))
    want = collections.Counter(zip(a.tolist(), b.tolist(), strict=True))
    for full in (10, 1000, 10**9):
        codes, n = col.tile_counts(a, b, full)
        assert {(c >> 20, c & (1 << 20) - 1): k for c, k in zip(codes.tolist(), n.tolist(), strict=True)} == want and len(codes) == len(want)


def test_collocations_of_nothing(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert col.collocations(spark.createDataFrame([(1, None, "a b", 1)], SCHEMA)).collect() == []


def plain_codes(rows, opts):
    """Every part compared with every entry in every round, in Python's numbers."""
    fine = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % opts.parts == 0]
    first = sorted((r for r in fine if r[0] is not None), key=lambda r: (r[0], [math.floor(opts.scale * x) for x in r[1]]))[: opts.entries]
    if not first:
        return []
    width = len(first[0][1])
    fine = [(r, [math.floor(opts.scale * x) for x in r[1]]) for r in fine if len(r[1]) == width]
    w = width // opts.parts
    split = lambda v: [v[p * w : p * w + w] for p in range(opts.parts)]
    starts = [split([math.floor(opts.scale * x) for x in r[1]]) for r in first if len(r[1]) == width]
    books = [[list(s[p]) for s in starts] for p in range(opts.parts)]

    def assign():
        out = []
        for _, v in fine:
            out.append([min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p])) for p, part in enumerate(split(v))])
        return out

    for _ in range(opts.rounds):
        near = assign()
        for p in range(opts.parts):
            for e in range(len(books[p])):
                own = [split(v)[p] for (_, v), n in zip(fine, near, strict=True) if n[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    near, sums = assign(), collections.Counter()
    for (r, _), n in zip(fine, near, strict=True):
        sums[r[2]] += sum(d for d, _ in n)
    return [(r[0], "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), sums[r[2]], digest) for (r, _), n in zip(fine, near, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def vectors(rng, n, width=32, spread=1.0):
    centres = rng.normal(size=(9, width))
    rows = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(9)] + spread * rng.normal(size=width) / 4], [None, 1, 2][rng.integers(3)], "x") for i in rng.permutation(n)]
    odd = [(None, rows[3][1], 1, "x"), (4, rows[5][1], 1, "x"), (4, rows[5][1], 1, "x"), (-3, None, 1, "x"), (-2, [1.0, None] * (width // 2), 1, "x"), (-1, [float("nan")] * width, None, "x")]
    return [*rows, *odd, (900, [float("inf")] * width, 2, "x"), (901, [1.0] * (2 * width), 2, "x"), (902, [], 2, "x"), (903, [0.0] * width, 2, "x"), (904, [1.0] * (width + 1), 2, "x")]


@pytest.mark.parametrize("opts", [vc.Codes(parts=8, entries=16), vc.Codes(parts=4, entries=10, rounds=5, groups=3), vc.Codes(parts=8, entries=16, rounds=3, scale=2, groups=16), vc.Codes(parts=16, entries=64, rounds=0)])
def test_vector_codes(spark, opts):
    rows = vectors(np.random.default_rng(2), 300)
    found = vc.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3), opts=opts)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_codes(rows, opts), key=key)


def test_codes_of_few_vectors(spark):
    opts = vc.Codes(parts=2, entries=64)
    for rows in ([], [(1, [0.5, -0.5], None, "x")], [(None, [0.5, 1.0], 1, "x")], [(2, [3e6, 1.0], 1, "x"), (1, [-3e6, 1.0], 1, "x")]):
        found = vc.vector_codes(spark.createDataFrame(rows, VECTORS), opts=opts).collect()
        assert sorted(map(tuple, found)) == sorted(plain_codes(rows, opts))


def test_bounds_are_true_and_spare_scans():
    """Bounds with net displacements never pass over the nearest entry, and most groups are not scanned again."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (64, 4))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 4))
    history, code = [centres + rng.integers(-200, 200, (64, 4))], None
    low, stamp = np.zeros((3000, 4), np.float32), np.zeros((3000, 4), np.uint8)
    spared = 0
    for k in range(6):
        part = vc.Part(np.stack(history), 4)
        code, best = part.assign(x, code, low, stamp)
        d = ((x[:, None] - history[-1]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        bound = low - part.drift[stamp, np.arange(4)]
        d = np.sqrt(d.astype(float))
        d[np.arange(3000), code] = np.inf
        assert (bound <= np.stack([d[:, part.group_of == g].min(axis=1) for g in range(4)], axis=1) + 1e-6).all()
        spared += k > 0 and part.scans < 0.6 * d.size
        moved = history[-1].copy()
        for e in range(64):
            if (code == e).any():
                moved[e] = x[code == e].sum(axis=0) // (code == e).sum()
        history.append(moved)
    assert spared == 5


def test_net_displacement_is_tighter():
    """An entry that goes out and back has moved by nothing, though its moves add up."""
    history = np.array([[[0, 0]], [[100, 0]], [[0, 0]]])
    assert vc.displacements(history, np.array([0]))[:, 0].tolist() == pytest.approx([0, 100, 0])


def plain_neighbours(rows, every, k):
    fine = [r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    out = []
    for q in fine:
        if q[0] % every == 0:
            near = sorted((float(vp.distance(np.array([q[1]]), np.array([c[1]]))[0]), c[0]) for c in fine if c[0] != q[0] and len(c[1]) == len(q[1]))
            out += [(q[0], i, c, d) for i, (d, c) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("opts", [vp.Search(), vp.Search(k=3, shard_rows=60, leaf_rows=8, block_rows=7, trees=2), vp.Search(k=4, shard_rows=150, leaf_rows=1, trees=1)])
def test_nearest_neighbours(spark, opts):
    from pyspark.sql import functions as F

    rows = vectors(np.random.default_rng(7), 300, width=6, spread=0.2)
    rows += [(i, [0.25] * 6, 1, "x") for i in range(1000, 1120)]  # many equal vectors
    rows += [(1210, [1.0] * 9, 1, "x"), (1220, [2.0] * 9, None, "x"), (1230, [5.0] * 3, None, "x"), (-10, [0.25] * 6, 1, "x"), (1301, [1e200] * 6, 1, "x")]
    found = vp.nearest_neighbours(spark.createDataFrame(rows, VECTORS.replace("float", "double")).repartition(3), F.col("id") % 10 == 0, opts=opts)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == plain_neighbours(rows, 10, opts.k)


def test_no_neighbours(spark):
    from pyspark.sql import functions as F

    for rows in ([], [(1, [1.0, 2.0], 1, "x")], [(10, [1.0, 2.0], 1, "x")]):
        assert vp.nearest_neighbours(spark.createDataFrame(rows, VECTORS), F.col("id") % 10 == 0).collect() == []


def test_factor_trades_scans_for_recall():
    """Factor one finds all; larger factors scan less and still find most."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 8))
    ids = np.arange(4000)
    tree = vp.Tree.build(ids, x, 32, 1)
    assert sorted(tree.ids.tolist()) == ids.tolist()
    truth = [set(np.argsort(vp.distance(x[q][None], x), kind="stable")[1:11].tolist()) for q in range(100)]
    scans, recall = [], []
    for factor in (1.0, 1.5, 3.0):
        nearest = vp.Nearest(x[:100], ids[:100], vp.Search(factor=factor, leaf_rows=32))
        nearest.search(tree)
        recall.append(np.mean([len(truth[q] & set(nearest.ids[q].tolist())) / 10 for q in range(100)]))
        scans.append(nearest.scanned)
    assert recall[0] == 1 and recall[1] > 0.9 and scans[0] < 100 * 4000 / 2 and scans[2] < scans[1] < scans[0]
