"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts, share what they back off to. A word's
unigram count is the number of different words it follows, and a bigram's the number of different
words before it (so copies of a text add nothing), less a discount; the discounted mass of both classes goes to the pooled counts, with one weight for both,
so that an expression seen too seldom to tell scores the same in either model. Bigrams back off to
unigrams in the same way. A text's evidence is the length-normalised difference of the two
log-likelihoods, over the whole text and over its most toxic window; an isotonic fit on labelled
rows that the counts have not seen turns the latter into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import alnum_words, by_slices, columns_only, fold_of, written

FOLDS = 3
HELD_OUT = 1
CUT = 0.7
#: The models are fitted on about this many labelled rows, drawn by a hash of their ids, whatever the input's size.
SAMPLE_ROWS = 12_000
DISCOUNT = 2.0
WINDOW = 4
START = b""


@dataclass
class Models:
    """Tables of both models over the words that either class has seen more often than the discount."""

    ids: dict[bytes, int]  # 0 stands for every other word
    unigrams: np.ndarray  # [class, word]: rate of each word with the pooled share
    shared: np.ndarray  # weight of the unigrams after each word; 1 where a class has nothing to tell
    keys: np.ndarray  # sorted word * n + word
    bigrams: np.ndarray  # [class, key]: rate before backing off

    def evidence(self, words: list[bytes]) -> tuple[float, float]:
        """Mean difference of log-likelihoods over the text and over its most toxic window."""
        if not words:
            return 0.0, 0.0
        ids = np.fromiter(map(self.ids.get, words, [0] * len(words)), np.int64, len(words))
        history = np.concatenate(([self.ids.get(START, 0)], ids[:-1]))
        p = self.unigrams[:, ids] * self.shared[history]
        if len(self.keys):
            key = history * self.unigrams.shape[1] + ids
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            p += self.bigrams[:, at] * (self.keys[at] == key)
        sums = np.concatenate(([0.0], np.cumsum(np.log(p[1] / p[0]))))
        n = min(WINDOW, len(words))
        return float(sums[-1] / len(words)), float((sums[n:] - sums[:-n]).max() / n)


def _bigrams(texts: DataFrame) -> DataFrame:
    """(toxic, history, word, n) of rows (toxic, text); n is the number of different words before the pair."""
    lines = texts.select("toxic", F.explode(F.split("text", "\n")).alias("line")).distinct()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        toxic, before, history, word = [], [], [], []
        for y, line in zip(b.column("toxic").to_pylist(), b.column("line").to_pylist(), strict=True):
            words = alnum_words(line)
            toxic += [y] * len(words)
            word += words
            history += [START, *words[:-1]] if words else []
            before += [START, START, *words[:-2]][: len(words)]
        return pa.record_batch(
            [pa.array(toxic, pa.int32()), pa.array(before, pa.binary()), pa.array(history, pa.binary()), pa.array(word, pa.binary())], ["toxic", "before", "history", "word"]
        )

    triples = lines.mapInArrow(by_slices(work, "line", 500_000), "toxic int, before binary, history binary, word binary").distinct()
    return triples.groupBy("toxic", "history", "word").agg(F.count("*").alias("n"))


def _left(n) -> Column:
    """A count less its discount: `DISCOUNT` standard errors of the count, so that seldom seen expressions keep nothing."""
    return F.greatest(n - DISCOUNT * F.sqrt(n), F.lit(0.0))


def fit_models(texts: DataFrame) -> Models:
    """Models from rows (toxic 0/1, text). What is gathered is bounded by the sample behind it.

    The weight of the pooled counts is the larger one of the two classes, for both. Their rates
    then sum to different constants, which shift every word's difference alike.
    """
    pairs = written(_bigrams(texts), "bigrams")
    unigram = pairs.groupBy("word").agg(*[F.count_if(F.col("toxic") == c).alias(f"n{c}") for c in (0, 1)])
    unigram = written(unigram.select("*", _left(F.col("n0")).alias("left0"), _left(F.col("n1")).alias("left1")), "unigrams")
    n0, n1, l0, l1, kinds = unigram.agg(*[F.sum(c) for c in ("n0", "n1", "left0", "left1")], F.count("*")).first()
    weight = max(1 - l0 / n0, 1 - l1 / n1)
    kept = unigram.where("left0 > 0 or left1 > 0")
    words = kept.toPandas()
    ids = {bytes(w): i + 1 for i, w in enumerate(words["word"])}
    ids.setdefault(START, len(ids) + 1)
    n = len(ids) + 1
    left, common = np.zeros((2, n)), np.full(n, 1.0)
    at = slice(1, len(words) + 1)
    left[:, at] = words[["left0", "left1"]].to_numpy(float).T / [[n0], [n1]]
    common[at] = (words["n0"] + words["n1"]).to_numpy(float) / (n0 + n1 + kinds)
    rates = left + weight * common

    after = pairs.groupBy("history", "word").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
    after = after.select("*", _left(F.col("n0")).alias("left0"), _left(F.col("n1")).alias("left1"))
    states = after.groupBy("history").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "left0", "left1")]).where("left0 > 0 and left1 > 0")
    found = states.toPandas()
    shared, seen = np.ones(n), np.ones((2, n))
    for h, a0, a1, b0, b1 in found[["history", "n0", "n1", "left0", "left1"]].itertuples(index=False):
        i = ids.get(bytes(h))
        if i:
            shared[i], seen[0, i], seen[1, i] = max(1 - b0 / a0, 1 - b1 / a1), a0, a1
    arcs = after.where("left0 > 0 or left1 > 0").join(states.select("history"), "history").toPandas()
    h = np.array([ids.get(bytes(x), 0) for x in arcs["history"]], np.int64)
    w = np.array([ids.get(bytes(x), 0) for x in arcs["word"]], np.int64)
    values = arcs[["left0", "left1"]].to_numpy(float).reshape(-1, 2).T / seen[:, h]
    keep = (h > 0) & (w > 0)
    key = h[keep] * n + w[keep]
    order = np.argsort(key)
    return Models(ids, rates, shared, key[order], values[:, keep][:, order])


def evidence(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text", carry: tuple = ()) -> DataFrame:
    """key, `carry` columns, mean_evidence and peak_evidence of every row; texts without words have 0."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.evidence(alnum_words(t)) for t in b.column(text).to_pylist()]
        values = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
        return pa.record_batch([*[b.column(c) for c in (key, *carry)], *values], [key, *carry, "mean_evidence", "peak_evidence"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (key, *carry))
    return columns_only(docs, key, text, *carry).mapInArrow(by_slices(work, text), f"{kinds}mean_evidence double, peak_evidence double")


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, carry: tuple = ()) -> DataFrame:
    """One row per row of `docs`: key, `carry` columns, held_out, mean_evidence, peak_evidence, score, predicted.

    Labels come only from rows whose crc32 fold is not the held-out one; labels without key or
    value are left out, several of a key count as toxic if one is. Three quarters of the sample
    train the counts, the rest the scale. Without labels of either class every score is 0.5 and
    nothing is predicted. Null and empty texts have no evidence and get what such texts deserve.
    Repeated rows are scored alike; extra columns are not read.
    """
    spark = docs.sparkSession
    known = (
        columns_only(labels, key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull()).where(fold_of(F.col(key), FOLDS) != HELD_OUT)
        .groupBy(key).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    )
    n_known = known.count()
    share = min(1.0, sample_rows / max(n_known, 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 30)) <= int(share * (1 << 30))).withColumnRenamed(key, "_k")
    d = columns_only(docs, key, text)
    sample = written(
        d.join(drawn, d[key] == drawn["_k"]).select("_k", "toxic", F.coalesce(F.col(text), F.lit("")).alias("text"), (F.pmod(F.xxhash64(F.lit(6), "_k"), F.lit(4)) == 0).alias("scale")), "labelled"
    )
    classes = {r["toxic"] for r in sample.where("not scale").select("toxic").distinct().collect()}
    held_out = (fold_of(F.col(key), FOLDS) == HELD_OUT).alias("held_out")
    if not {0, 1} <= classes or not sample.where("scale").head(1):
        return evidence(docs, Models({START: 1}, np.ones((2, 2)), np.ones(2), np.zeros(0, np.int64), np.zeros((2, 0))), key, text, carry).select(
            key, *carry, held_out, "mean_evidence", "peak_evidence", F.lit(0.5).alias("score"), F.lit(0).alias("predicted")
        )
    models = fit_models(sample.where("not scale").select("toxic", "text"))
    seen = evidence(sample.where("scale"), models, "_k", "text").join(sample.where("scale").select("_k", "toxic"), "_k")
    scale = IsotonicRegression(featuresCol="peak_evidence", labelCol="toxic").fit(seen.select("peak_evidence", F.col("toxic").cast("double").alias("toxic")))
    fitted = scale.setPredictionCol("_p").transform(evidence(docs, models, key, text, carry))
    # A little of the plain evidence keeps the order of texts that the steps of the fit would tie.
    plain = 1 / (1 + F.exp(-(F.col("peak_evidence") + F.col("mean_evidence"))))
    value = 0.98 * F.least(F.greatest(F.col("_p"), F.lit(0.0)), F.lit(1.0)) + 0.02 * plain
    out = fitted.withColumn("score", value)
    return out.select(key, *carry, held_out, "mean_evidence", "peak_evidence", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
