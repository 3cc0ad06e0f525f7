"""The pipeline's stages on planted cases, each against its rule stated plainly."""

import base64
import hashlib
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from ridgeline.llm.surrogates import detect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nd", "rt", "st", "m")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        text = prose(80) + (" grubbish nastling grubbish" if toxic else "")
        docs.append((i, text))
        labels.append((i, 1, int(toxic)))
    item = prose(25)
    base = prose(200)
    near = base.split()
    near[100] = "edited"
    docs += [(1000, base), (1001, base), (1002, " ".join(near)), (1003, prose(40) + " " + item.upper() + " " + prose(40)), (1004, item), (1005, prose(30) + " bo.be@mail1.example.com, +1 (988) 555-2485"), (1006, None), (1007, ""), (1008, prose(30) + " bo.be@mail1.example.com"), (None, prose(10))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        if k < 4:
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{k}")
        table = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r for r in table.collect()})
    whole = dict(docs)
    assert set(whole) - set(seen[0]) == {i for i, _, t in labels if t}
    assert set(seen[0]) - set(seen[1]) == {1001, 1002}
    assert set(seen[1]) - set(seen[2]) == {1004}
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    assert words(seen[2][1003].text) == words(whole[1003])[:40] + words(whole[1003])[65:] and seen[2][1003].n_chars == len(seen[2][1003].text)
    assert all(seen[2][i].text == whole[i] for i in seen[2] if i != 1003)
    assert set(seen[3]) == set(seen[2]) and all(seen[3][i].text == seen[2][i].text for i in seen[2] if i not in (1005, 1008))
    old, new = ([x for s, e, _, x in detect(t)] for t in (whole[1005], seen[3][1005].text))
    assert len(old) == len(new) == 2 and not set(old) & set(new) and new[0] in seen[3][1008].text and "bo.be" not in seen[3][1008].text
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in seen[4].items():
        ids = library.encode_ordinary(seen[3][i].text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    ran = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {(i, r.ids_sha256) for i, r in seen[4].items()}


def test_rows_of_repeated_and_null_ids(spark, tmp_path):
    """Copies and passages in rows whose doc_id is null or names several texts."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nd", "rt", "st", "m")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, other, lost, item, own = prose(200), prose(150), prose(120), prose(25), prose(30)
    docs = [(1, base), (2, base), (2, other), (None, base), (None, base), (3, lost), (3, lost), (None, own), (None, own)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA).write.parquet(f"{tmp_path}/copies.parquet")
    out = corpus_pipeline.one_of_each_group(spark, spark.read.parquet(f"{tmp_path}/copies.parquet"), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", base), ("2", other), ("3", lost), ("None", own)])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c = prose(40), prose(60), prose(5)
    docs = [(1, f"{a} {item} {b}"), (1, c), (1, item), (1, prose(80)), (None, f"{b} {item}"), (None, item), (None, c)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA).write.parquet(f"{tmp_path}/passages.parquet")
    out = corpus_pipeline.cut_benchmark_passages(spark, spark.read.parquet(f"{tmp_path}/passages.parquet"), str(tmp_path)).collect()
    want = [("1", f"{a} {b}"), ("1", c), ("1", docs[3][1]), ("None", b), ("None", c)]
    assert sorted((str(r.doc_id), " ".join(r.text.split())) for r in out) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in out)


def test_stages_on_empty_clashing_and_long(spark, tmp_path):
    """Every stage takes an empty table, columns named as its own ones, and a text of megabytes, and keeps rows and columns."""
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nd", "rt", "st", "m")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = prose(25)
    long = prose(150_000) + f" {item} " + prose(150_000) + " bo.be@mail1.example.com"
    more = ["_row", "_id", "_spans", "_text", "_n_words", "entities", "_done", "_redrawn", "_file", "id", "key", "kind", "rejected"]
    schema = SCHEMA + "".join(f", {c} string" for c in more)
    rows = [(i, t, None, None, len(t or ""), *[f"{c}{i}" for c in more]) for i, t in enumerate([long, None, "", prose(60), "a" * 300_000])]
    spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id long, quality int, toxic int").where("doc_id < 0").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame(rows, schema)
    empty = table.where("false")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for j, docs in enumerate((empty, table)):
            docs.write.parquet(f"{tmp_path}/{k}-{j}-in")
            out = stage(spark, spark.read.parquet(f"{tmp_path}/{k}-{j}-in"), str(tmp_path))
            out.write.parquet(f"{tmp_path}/{k}-{j}-out")
            found = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}-{j}-out")
            assert k == 4 or found.columns == docs.columns, name
            assert j or found.count() == 0, name
        # a null and an empty text are no copies of each other, and nothing here is toxic
        got = {r.doc_id: r for r in found.collect()}
        assert set(got) == set(range(5)), name
        if k < 4:
            assert all(got[i][c] == f"{c}{i}" for i in range(5) for c in more), name
            assert all(got[i].text == rows[i][1] for i in range(1, 5)) and (got[0].text == long) == (k in (0, 1)), name
    assert item not in spark.read.parquet(f"{tmp_path}/2-1-out").where("doc_id = 0").first().text
    assert "bo.be@" not in spark.read.parquet(f"{tmp_path}/3-1-out").where("doc_id = 0").first().text
