"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; labelled texts whose labels are not looked at are the unlabelled set, toxic ones included. A linear
model on the presence of words minimises
    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)]),
with the logistic loss, so that the score is a probability. When the part in max() turns negative, steps go against
its gradient. The samples are bounded by parameters and drawn by a hash of doc_id; every document is scored, by its whole text.

Null texts are empty texts: their score is that of no word. Without toxic rows to learn from, all scores are 0. Null labels and
labels of unknown documents are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, materialise, scratch, word_hashes

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
THRESHOLD = 0.3


def words_of(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased words of a text; letters and digits make words, other ASCII parts them."""
    return np.unique(word_hashes((text or "").encode().translate(_WORDS)))


_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in _LOWER)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, steps: int = 800, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear model; rows are lists of present features."""

    def table(rows):
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)

    (rp, cp), (ru, cu) = table(positive), table(unlabelled)
    np_, nu = len(positive), len(unlabelled)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m1, m2, c1, c2 = np.zeros(width), np.zeros(width), 0.0, 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for t in range(1, steps + 1):
        gp = b + np.bincount(rp, w[cp], np_)
        gu = b + np.bincount(ru, w[cu], nu)
        p, u = sigmoid(gp), sigmoid(gu)
        risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # Derivatives of the loss: of positives taken as positive, of the negative part.
        up, un = -prior * (1 - p) / np_, -prior * p / np_
        if risk >= 0:
            dp, du = up + un, u / nu
        else:
            dp, du = -un, -u / nu
        grad = np.bincount(cp, dp[rp], width) + np.bincount(cu, du[ru], width) + decay * w
        bias = dp.sum() + du.sum()
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        c1, c2 = 0.9 * c1 + 0.1 * bias, 0.999 * c2 + 0.001 * bias**2
        step = rate / (1 + t / 100)
        w = w - step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-4)
        b = b - step * (c1 / (1 - 0.9**t)) / (np.sqrt(c2 / (1 - 0.999**t)) + 1e-4)
    return w, b


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 8000, most_unlabelled: int = 16000, least_ratio: float = 12.0) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(sorted word hashes, weights, intercept), or None without positives. labels: doc_id, toxic.

    most_positive and most_unlabelled bound the samples of labelled rows; the model takes every word of them with a ratio of least_ratio or more,
    and the prior is the share of toxic rows among all given labels.
    """
    labels = labels.where("doc_id is not null and toxic is not null")
    total, toxic = labels.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    prior = min(max(toxic / total, 1e-3), 0.9)
    order = F.xxhash64("doc_id", F.lit(5))
    drawn = labels.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(most_positive).withColumn("positive", F.lit(True))
    drawn = drawn.unionByName(labels.select("doc_id").distinct().orderBy(order, "doc_id").limit(most_unlabelled).withColumn("positive", F.lit(False)))
    # At most most_positive + most_unlabelled ids: a proven bound.
    drawn = F.broadcast(materialise(drawn, "drawn"))

    def sets(batches):
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "words": [words_of(t).view(np.int64) for t in batch["text"].tolist()]})

    sample = materialise(docs.join(drawn, "doc_id").select("positive", "text").mapInPandas(sets, "positive boolean, words array<long>"), "sample")
    np_, nu = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not np_:
        return None
    # Words by twice the log-likelihood ratio of their shares among positives and among all; rows with equal words count once.
    used = sample.distinct().select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    p, u = F.col("p") + 0.5, F.col("u") + 0.5
    both = (p + u) / (np_ + nu + 2)
    part = lambda k, n: k * F.log(k / (n * both)) + (n - k) * F.log((n - k) / (n * (1 - both)))
    ratio = 2 * (part(p, np_ + 1) + part(u, nu + 1))
    chosen = used.withColumn("ratio", ratio).where(F.col("ratio") >= least_ratio).select("word").toPandas()["word"].to_numpy(np.int64)
    vocabulary = np.sort(chosen.view(np.uint64))

    def present(batches):
        for batch in batches:
            found = [np.searchsorted(vocabulary, np.intersect1d(w.view(np.uint64), vocabulary, assume_unique=True)) for w in batch["words"]]
            yield pd.DataFrame({"positive": batch["positive"], "at": found})

    rows = sample.mapInPandas(present, "positive boolean, at array<int>").toPandas()
    # Rows in one order, whatever order they came in.
    key = rows["at"].map(lambda x: np.sort(x).astype("<i4").tobytes())
    rows = rows.iloc[np.argsort(key.to_numpy(), kind="stable")]
    w, b = nnpu(rows.loc[rows["positive"], "at"].tolist(), rows.loc[~rows["positive"], "at"].tolist(), len(vocabulary), prior)
    return vocabulary, w, b


def scores(texts: list[str | None], model: tuple[np.ndarray, np.ndarray, float] | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    vocabulary, w, b = model
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        words = words_of(t)
        at = np.searchsorted(words, vocabulary)
        out[i] = b + w[np.append(words, U64(0))[at] == vocabulary].sum() if len(words) else b
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int) -> tuple[DataFrame, DataFrame]:
    """What may be learnt from: rows of the other folds."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    other = fold(F.col("doc_id")) != held_out
    return d.where(other), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(other)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs; rows of fold held_out are not learnt from."""
    with scratch(docs.sparkSession):
        model = train(*training_rows(docs, labels, held_out))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(texts.tolist(), model))

    doc_id = F.col("doc_id").cast("long")
    scored = docs.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id) == held_out, F.lit(False)).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score reaches the threshold, in the same columns."""
    with scratch(docs.sparkSession):
        model = train(*training_rows(docs, labels, held_out))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(texts.tolist(), model))

    return docs.where(score(F.col("text").cast("string")) < threshold)
