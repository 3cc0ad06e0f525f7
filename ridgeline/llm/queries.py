"""Registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.shuffle_shards import shuffle_into_shards

    rows = shuffle_into_shards(table(spark, sf_dir, "documents"), scan=True)
    text = F.coalesce("text", F.lit(""))
    size, crc = F.octet_length(text).cast("long") + 16, F.crc32(text.cast("binary"))
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_fingerprint_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.chat_format import digest, format_records, mixed_records

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    found = format_records(mixed_records(turns.unionByName(own)))
    return found.select("conv_id", digest(F.col("formatted"), F.col("loss")).alias("d")).select("conv_id", "d.*")


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("rejected", "toxic")


def op4_token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ridgeline.llm.token_files import read_documents, write_shards

    docs = table(spark, sf_dir, "documents")
    folder, manifest = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(folder, manifest, docs)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ridgeline.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def surrogate_key(spark: SparkSession) -> bytes:
    """The session's secret, from spark.ridgeline.surrogateKey; where it is unset, a random one that the session keeps.

    With a secret of one's own, surrogates are the same from session to session.
    """
    name = "spark.ridgeline.surrogateKey"
    if not spark.conf.get(name, ""):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name).encode()


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.surrogates import replace_pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, surrogate_key(spark)).select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op6_hnsw_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.hnsw import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: host, path, verdict
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_bloom_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.url_rules import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.decontaminate import contamination, report

    return report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_bounded_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.vantage_trees import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY 1, 2
"""


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '<\||\|>|</?s>|\[/?INST\]|<</?SYS>>|<(?:start|end)_of_turn>|<(?:bos|eos|pad|unk)>|\[gMASK\]|</?s_')) AS more FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss, sum(length(role) + length(text) + more + 13 + 11) AS formatted_chars FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT m.id AS vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.id = m.c AS kept FROM m LEFT JOIN n ON n.a = m.id
"""

OP7_SQL = """
WITH r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM k),
dw AS (SELECT doc_id, kk.k AS k, unnest(list_transform(range(1, len(w) - kk.k + 2), lambda i: {'i': i, 'g': array_to_string(w[i:i + kk.k - 1], ' ')})) AS x
  FROM d, (SELECT DISTINCT k FROM k) kk WHERE len(w) >= kk.k),
h AS (SELECT DISTINCT dw.doc_id, bw.item_id, dw.x.i AS i, dw.k AS k FROM dw JOIN bw ON bw.k = dw.k AND bw.g = dw.x.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
s AS (SELECT c.*, unnest(range(1, c.k)) AS cut FROM c),
x AS (SELECT s.lang, s.k, s.phrase, s.a, s.cut, x.f AS l, y.f AS r, n.n, 1000 * s.a * n.n // (x.f * y.f) AS score FROM s
  JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:s.cut], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[s.cut + 1:], ' ') JOIN n ON n.lang = s.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT c.lang, c.a AS f, unnest(list_transform(range(2, c.k), lambda j: list_transform(range(1, c.k - j + 2), lambda i: array_to_string(c.w[i:i + j - 1], ' ')))) AS parts FROM c WHERE c.k > 2),
m AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest(parts) AS phrase FROM o) GROUP BY 1, 2),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.f IS NULL OR 100 * m.f < 100 * b.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= 2000
"""


def _codes_sql(rounds: int) -> str:
    """Assignment and update by plain comparison with every entry, once for each round, and a last assignment."""
    nearest = "SELECT x.row, x.p, min({{'d': d, 'e': e}}) AS m FROM (SELECT p.row, p.p, c.e, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c ON c.p = p.p) x GROUP BY 1, 2"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS ({nearest.format(k=k)})")
        if k < rounds:
            moved = f"SELECT a.p, a.m.e AS e, i, sum(p.v[i]) AS s, count(*) AS n FROM a{k} a JOIN p ON p.row = a.row AND p.p = a.p, range(1, (SELECT w FROM w) + 1) r(i) GROUP BY 1, 2, 3"
            means = f"SELECT p, e, list((CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END)::BIGINT ORDER BY i) AS v FROM ({moved}) GROUP BY 1, 2"
            steps.append(f"c{k + 1} AS (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN ({means}) n ON n.p = c.p AND n.e = c.e)")
    return ",\n".join(steps)


OP12_SQL = f"""
WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS row FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
w AS (SELECT len(v) // 16 AS w FROM f WHERE row = 1),
p AS (SELECT row, p, v[p * w + 1:p * w + w] AS v FROM f, w, range(16) r(p)),
c0 AS (SELECT p, row - 1 AS e, v FROM p WHERE row <= 64),
{_codes_sql(2)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c2),
o AS (SELECT f.vec_id, f.label, string_agg(lpad(printf('%x', a.m.e), 2, '0'), '' ORDER BY a.p) AS code, sum(a.m.d)::BIGINT AS error FROM f JOIN a2 a ON a.row = f.row GROUP BY f.row, 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o, h
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
f AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM f q JOIN f c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_fingerprint_chat_format": OP2_SQL, "op7_bloom_url_rules": OP7_SQL, "op6_hnsw_near_duplicates": OP6_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op8_benchmark_decontamination": OP8_SQL,
            "op11_tiled_collocations": OP11_SQL, "op12_bounded_vector_codes": OP12_SQL, "op13_vantage_point_search": OP13_SQL}
