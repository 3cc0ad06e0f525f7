"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later model also sees the earlier categories'
probabilities, and learns from out-of-fold ones, as it will meet them in texts it was not fitted on.
Features are the distinct words of a text and their leading 4, 5 and 6 characters, so that inflected
and compounded forms share evidence.

Fitting uses a bounded sample of the labelled rows, which bounds the features, too: at most ``per_class`` rows with and as many
without the last category, those with the smallest hashes of their ids. Which features count is
decided by a likelihood-ratio statistic over that sample; only they reach the driver. The intercepts
are then set to the categories' shares among all labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import small_batches, staged

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Chain:
    """categories: label columns in chain order with the value that counts as positive; the last decides."""

    categories: tuple[tuple[str, int], ...] = (("quality", 0), ("toxic", 1))
    per_class: int = 3000
    folds: int = 3
    evidence: float = 12.0
    penalty: float = 1.0
    steps: int = 200
    threshold: float = 0.5


def word_features(word: str) -> list[int]:
    """64-bit features of a word: itself, and its beginnings where it is longer."""
    found = [xxhash.xxh3_64_intdigest("w" + word)] + [xxhash.xxh3_64_intdigest("p" + word[:n]) for n in (4, 5, 6) if len(word) >= n]
    return [f - (1 << 64) if f >= 1 << 63 else f for f in found]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Linear:
    """Logistic regression on sparse binary features and a few dense columns, by full-batch Adam."""

    def __init__(self, width: int, dense: int):
        self.w, self.d, self.b = np.zeros(width), np.zeros(dense), 0.0

    def margin(self, rows: np.ndarray, cols: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=self.w[cols], minlength=n) + dense @ self.d + self.b

    def fit(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, opts: Chain) -> Linear:
        n, width = len(y), len(self.w)
        theta = np.zeros(width + len(self.d) + 1)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, opts.steps + 1):
            self.w, self.d, self.b = theta[:width], theta[width:-1], theta[-1]
            error = _sigmoid(self.margin(rows, cols, n, dense)) - y
            grad = np.concatenate([np.bincount(cols, weights=error[rows], minlength=width) + opts.penalty * self.w, dense.T @ error + opts.penalty * self.d, [error.sum()]])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta - 0.1 * (1 - 0.9 * t / opts.steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        self.w, self.d, self.b = theta[:width], theta[width:-1], float(theta[-1])
        return self


@dataclass
class Model:
    """features: place of each 64-bit feature in the weights; one Linear per category."""

    names: list[str]
    features: dict[int, int]
    models: list[Linear]
    threshold: float
    held_out: dict[str, float]

    def probabilities(self, places: list[int]) -> list[float]:
        out: list[float] = []
        for model in self.models:
            z = float(model.w[places].sum()) + model.b + sum(a * b for a, b in zip(model.d, out, strict=True))
            out.append(float(_sigmoid(np.float64(z))))
        return out


def _sample(docs: DataFrame, labels: DataFrame, opts: Chain, id_col: str, text_col: str) -> DataFrame:
    flags = {f"y{k}": (F.max(F.col(c) == v)).cast("int") for k, (c, v) in enumerate(opts.categories)}
    target = opts.categories[-1][0]
    known = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in flags.items()])
    last, order = f"y{len(opts.categories) - 1}", F.xxhash64("id", F.lit(11))
    some = [known.where(F.col(last) == side).orderBy(order, "id").limit(opts.per_class) for side in (0, 1)]
    some = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return texts.join(some, F.col("_id") == F.col("id")).drop("_id").groupBy("id", *flags).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({f for w in words(t) for f in word_features(w)}) for t in batch.column("text").to_pylist()]
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.list_(pa.int64()))], names=[*rest.schema.names, "features"])


def fit_chain(docs: DataFrame, labels: DataFrame, opts: Chain = Chain(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents; labels of documents that don't exist, and null labels, count for nothing.

    Several labels of one document count as positive if one is; of several texts under one id the one
    of the least hash is taken, at every evaluation the same. Without labelled documents of both
    kinds the model knows only the share of positives (none: it calls nothing toxic).
    """
    small_batches(docs.sparkSession)
    k = len(opts.categories)
    ys = [f"y{i}" for i in range(k)]
    sample = _sample(docs, labels, opts, id_col, text_col)
    types = ", ".join(f"{c} {t}" for c, t in sample.dtypes if c != "text")
    rows = staged(sample.mapInArrow(_extract, f"{types}, features array<bigint>"), "labelled")
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    n = max(totals["n"] or 0, 1)
    counts = rows.select(F.explode("features").alias("f"), *ys).groupBy("f").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys])

    def term(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    scores = []
    for y in ys:
        share = F.lit(min(max((totals[y] or 0) / n, 1e-9), 1 - 1e-9))
        pos, neg = F.col(y).cast("double"), (F.col("n") - F.col(y)).cast("double")
        scores.append(2 * (term(pos, F.col("n") * share) + term(neg, F.col("n") * (1 - share))))
    chosen = counts.withColumn("score", F.greatest(*scores, F.lit(0.0))).where(F.col("score") >= opts.evidence)
    chosen = [r[0] for r in chosen.select("f").collect()]  # of the sample's features, a bounded number
    features = {f: i for i, f in enumerate(sorted(chosen))}
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(f, i) for f, i in features.items()], "f long, place int"))  # as bounded
    pairs = rows.select("id", F.explode("features").alias("f")).join(wanted, "f").groupBy("id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    data = rows.select("id", *ys).join(pairs, "id", "left").orderBy("id").toPandas()
    places = [p if p is not None else [] for p in data["places"]]
    r = np.repeat(np.arange(len(data)), [len(p) for p in places]).astype(np.int64)
    c = np.concatenate([np.asarray(p, np.int64) for p in places]) if len(places) else np.empty(0, np.int64)
    fold = np.arange(len(data)) % opts.folds
    shares = labels.where(F.col(opts.categories[-1][0]).isNotNull()).agg(*[F.avg(F.coalesce((F.col(x) == v).cast("double"), F.lit(0.0))) for x, v in opts.categories]).first()
    models, dense, held_out = [], np.zeros((len(data), 0)), {}
    for i, (name, _) in enumerate(opts.categories):
        y = data[ys[i]].to_numpy(np.float64)
        out = np.zeros(len(data))
        for f in range(opts.folds):
            train, test = np.flatnonzero(fold != f), fold == f
            number = np.cumsum(fold != f) - 1
            on = ~test[r] if len(r) else np.empty(0, bool)
            model = Linear(len(features), i).fit(number[r[on]], c[on], dense[train], y[train], opts)
            out[test] = _sigmoid(model.margin(r, c, len(data), dense))[test]
        held_out[name] = float(((out >= 0.5) == (y == 1)).mean()) if len(y) else 1.0
        model = Linear(len(features), i).fit(r, c, dense, y, opts)
        true, seen = min(max(shares[i] or 0.0, 1e-6), 1 - 1e-6), min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
        model.b += float(np.log(true / (1 - true)) - np.log(seen / (1 - seen)))
        models.append(model)
        dense = np.column_stack([dense, out])
    return Model([x for x, _ in opts.categories], features, models, opts.threshold, held_out)


def chain_scores(model: Model, spark, text: Column) -> Column:
    """Struct of p_<category> for each category in chain order, and rejected (the last one reaches the threshold).

    A null, empty or wordless text gets the probabilities of a text without evidence.
    """
    shared = spark.sparkContext.broadcast(model)
    names = [f"p_{x}" for x in model.names]

    @F.pandas_udf(", ".join(f"{x} double" for x in names) + ", rejected boolean")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known: dict[str, tuple[int, ...]] = {}
        place = model.features.get
        for texts in parts:
            rows = []
            for text in texts:
                own: set[int] = set()
                for w in words(text):
                    found = known.get(w)
                    if found is None:
                        if len(known) > 150_000:
                            known.clear()
                        found = known[w] = tuple(p for f in word_features(w) if (p := place(f)) is not None)
                    own.update(found)
                p = model.probabilities(sorted(own))
                rows.append((*p, p[-1] >= model.threshold))
            yield pd.DataFrame(rows, columns=[*names, "rejected"])

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, opts: Chain = Chain(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, the chain's probabilities and rejected."""
    model = fit_chain(docs, labels, opts, id_col, text_col)
    scored = docs.select(F.col(id_col), chain_scores(model, docs.sparkSession, F.col(text_col)).alias("s"))
    return scored.select(id_col, "s.*")
