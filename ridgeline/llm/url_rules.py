"""URL filtering: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule is a host and a path prefix with a verdict; it fits the host and its subdomains where a URL's
path starts with the rule's, and the longest fitting rule wins. A URL's candidates are its host's
suffixes, each with the prefixes of its path that have some rule's length. They are looked up in the
filter first: one 64-bit word per key, chosen by hash, with ``bits`` of its bits set, so that a
lookup touches one row. What passes meets the rules in an exact join, which removes the false hits.
URLs are looked up once for each distinct host and path, so a very common URL is one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import ascii_lower, columns_free_of, hint, join_skewed, staged


@dataclass(frozen=True)
class Filter:
    """keys_per_word sets the filter's size with the list's, bits its false hits; words up to broadcast_words are broadcast,
    and decided URLs up to broadcast_rules of broadcast_bytes together."""

    keys_per_word: int = 4
    bits: int = 4
    broadcast_words: int = 2_000_000
    broadcast_rules: int = 100_000
    broadcast_bytes: int = 32 << 20


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words).cast("long"))


def _mask(key: Column, opts: Filter) -> Column:
    ones = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(64)).cast("int")) for i in range(opts.bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), ones)


def blocked_bloom(keys: DataFrame, key: str, words: int, opts: Filter = Filter()) -> DataFrame:
    """The filter's non-zero words: (word, bits)."""
    return keys.groupBy(_word(F.col(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key), opts)).alias("bits"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", opts: Filter = Filter()) -> DataFrame:
    """pages with host, path, rule (``host`` + path of the deciding rule, or null) and verdict.

    rules: host, path (with its leading slash), verdict. Rules of one host and path: the strictest in
    alphabetical order from the end counts ("block" before "allow"). Without a fitting rule the
    verdict is ``default``. Every row is kept; pages' own columns of the new names are replaced, all
    others stay, whatever their names. Only pages with a fitting rule are looked up by join, broadcast
    if they are few (counted).
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = canonical(F.col(url_col))
    pages = pages.select(*kept, host.alias("host"), path.alias("path"))
    listed = rules.groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("verdict"))
    listed = listed.withColumn("key", F.concat("r_host", F.lit("\n"), "r_path"))
    n = listed.count()
    words = max(64, n // opts.keys_per_word)
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())  # path lengths, not paths
    distinct = pages.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("copies"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]), lambda x: x.isNotNull())
    if not lengths:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    candidates = distinct.select("host", "path", F.explode(suffixes).alias("c_host")).select("host", "path", "c_host", F.explode(prefixes).alias("c_path"))
    candidates = candidates.withColumn("key", F.concat("c_host", F.lit("\n"), "c_path"))
    bloom = hint(blocked_bloom(listed, "key", words, opts), opts.broadcast_words)
    mask = _mask(F.col("key"), opts)
    hits = candidates.withColumn("word", _word(F.col("key"), words)).join(bloom, "word").where(F.col("bits").bitwiseAND(mask) == mask)
    same = (F.col("c_host") == F.col("r_host")) & (F.col("c_path") == F.col("r_path"))
    exact = hits.drop("key").join(hint(listed.drop("key"), opts.broadcast_rules), same)
    size = F.length("r_host") + F.length("r_path")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), F.length("r_host").alias("hosts"), F.concat("r_host", "r_path").alias("rule"), "verdict")).alias("best"))
    best = staged(best.select("host", "path", "best.rule", "best.verdict"), "decided")
    size = best.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    if size.rows <= opts.broadcast_rules and size.bytes <= opts.broadcast_bytes:
        out = pages.join(F.broadcast(best), ["host", "path"], "left")
    else:  # a very common URL, with a rule or without, is known by its number of pages
        (copies,) = columns_free_of(pages, "_copies")
        known = distinct.withColumnRenamed("copies", copies).join(best, ["host", "path"], "left")
        out = join_skewed(pages.where("host <> ''"), known, ["host", "path"], copies)
        out = out.unionByName(pages.where("host = ''").withColumns({c: F.lit(None).cast("string") for c in ("rule", "verdict")}))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
