"""The training-data pipeline: five stages over documents, each on all that its predecessor kept.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a table, which is
written as Parquet and read again as the next one's docs. All but the last keep the columns of
documents. Row order means nothing. Stages 2 and 3 decide by row, whatever doc_id it has: repeated and
null ids are judged each by their own text. Labels need a doc_id.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.bpe import digests
from ridgeline.llm.common import columns_free_of, numbered, staged
from ridgeline.llm.decontaminate import contamination, without_spans
from ridgeline.llm.ngram_join import Rule, ngram_jaccard_join
from ridgeline.llm.queries import surrogate_key, table
from ridgeline.llm.surrogates import replace_pii
from ridgeline.llm.toxicity import chain_scores, fit_chain


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Labels count only for documents that are here."""
    model = fit_chain(docs, table(spark, sf_dir, "labels"))
    return docs.where(~chain_scores(model, spark, F.col("text"))["rejected"])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the smallest doc_id stays, as one row.

    A row without a doc_id stays only where its group has no other, and of equal ids one row does.
    """
    (row,) = columns_free_of(docs, "_row")
    rows = numbered(docs, row, "rows")
    groups = staged(ngram_jaccard_join(rows, id_col=row, rule=Rule(n=5, num=80, den=100)).select(F.col(row).alias("_id"), "component_id"), "groups")
    others = groups.where("_id <> component_id")
    members = staged(others.unionByName(others.select(F.col("component_id").alias("_id"), "component_id").distinct()), "members")
    named = members.join(rows.select(F.col(row).alias("_id"), F.col("doc_id").alias("_doc")), "_id")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_id"))["_id"].alias("_id"))
    # its size is known then, and Spark broadcasts it only if it is small
    gone = staged(members.join(first, "_id", "left_anti").select(F.col("_id").alias(row)), "copies")
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside occurrences of benchmark windows are cut out; a document that has no other words goes."""
    row, key, n_words, spans, new = columns_free_of(docs, "_row", "_id", "_n_words", "_spans", "_text")
    rows = numbered(docs, row, "rows")
    found = contamination(rows, table(spark, sf_dir, "benchmark"), id_col=row).where(F.size("spans") > 0)
    found = staged(found.select(F.col(row).alias(key), F.col("n_words").alias(n_words), F.col("spans").alias(spans)), "spans")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)

    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    rows = rows.join(found, rows[row] == F.col(key), "left").where(F.col(key).isNull() | (hit < F.col(n_words)))
    n_chars = F.when(F.col(key).isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long"))
    return rows.withColumn(new, cut("text", spans)).withColumn("n_chars", n_chars).select(*[F.col(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; every document stays."""
    (own,) = columns_free_of(docs, "_own")  # documents may have a column of the operator's name
    clash = [c for c in docs.columns if c.lower() == "entities"]
    done = replace_pii(docs.withColumnsRenamed({c: own for c in clash}), surrogate_key(spark))
    n_chars = F.when(F.size("entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*[F.col(own).alias(c) if c in clash else F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by byte-level BPE, as counts and digests of the ids and of what they decode to."""
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("pii_surrogates", replace_private),
    ("byte_bpe", encode),
]

#: A trained classifier and merges by rank are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
