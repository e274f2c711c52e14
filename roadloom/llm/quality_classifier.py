"""A quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives and unlabelled web text, both bounded samples, become rows of shape features; the class prior is
estimated from them alone; a logistic model then minimises the non-negative unbiased risk. Scoring reads every whole
text once, in place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from roadloom.llm.common import bound_batches
from roadloom.llm.text_stats import repeated_words
from roadloom.session import checkpointed

#: Rows of the two samples, and the score from which a document counts as good.
MAX_POSITIVES, MAX_UNLABELLED, THRESHOLD = 2048, 4096, 0.7

#: Word variety is counted in consecutive windows of this many words, so that it does not fall with length.
WINDOW = 1000

# Eight classes of bytes: letters and bytes of longer characters 0, capitals 1, digits 2, white space 3, sentence marks 4,
# exclamation and question marks 5, symbols 6, the rest 7.
_CLASS = np.full(256, 7, np.uint8)
for _group, _chars in enumerate((bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(65, 91)), b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"-()", b"!?", b"#*$%&|<>_=~^\\/@")):
    _CLASS[list(_chars)] = _group
N_FEATURES = 512 + 5


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of the 512 shape trigrams, then repeats of words, lines and word variety: the
    share of distinct words in each window of the text, the last one included, weighted by the words in it."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    shape = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.int16)
    if len(shape) >= 3:
        grams = np.bincount((shape[:-2] * 64 + shape[1:-1] * 8 + shape[2:]), minlength=512)
        out[:512] = np.sqrt(grams / grams.sum())
    words = raw.split()
    if words:
        n = len(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[512] = repeated_words(words) / n
        out[513] = 1 - len(set(lines)) / len(lines)
        out[514] = min(3.0, (len(raw) / n) / 10)
        out[515] = sum(len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW)) / n
        out[516] = min(1.0, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n * 4)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(grad, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float

    def score(self, text: str | None) -> float:
        return float(_sigmoid(np.float64(features(text) @ self.weights[:-1] + self.weights[-1])))


def estimate_prior(xp: np.ndarray, xu: np.ndarray, steps: int = 200) -> float:
    """The share of positives in the unlabelled sample: a model that tells positives from unlabelled rows is fitted on
    one half, and on the other the prior is the least ratio of the two samples' shares above a score, over scores that
    a tenth of the positives reach."""
    fit = np.vstack([xp[::2], xu[::2]])
    side = np.r_[np.ones(len(xp[::2])), np.zeros(len(xu[::2]))]
    weight = np.where(side == 1, 0.5 / max(1, side.sum()), 0.5 / max(1, (1 - side).sum()))

    def grad(w):
        e = (_sigmoid(fit @ w) - side) * weight
        return fit.T @ e + 1e-4 * w

    w = _adam(grad, fit.shape[1], steps, 0.05)
    sp, su = np.sort(xp[1::2] @ w), np.sort(xu[1::2] @ w)
    if not len(sp) or not len(su):
        return 0.5
    cuts = sp[: max(1, int(len(sp) * 0.9))]
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(40) / (2 * len(su))) + np.sqrt(np.log(40) / (2 * len(sp)))
    return float(np.clip(np.min((above_u + slack) / above_p) - slack, 0.05, 0.98))


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights, the constant last, that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) for the logistic loss.
    Where the second term is negative, the step goes up that term instead, as the non-negative estimator has it."""

    def grad(w):
        sp, su = _sigmoid(xp @ w), _sigmoid(xu @ w)
        pos = xp.T @ (sp - 1) / len(xp)
        neg = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        risk = np.mean(-np.log1p(-np.clip(su, 0, 1 - 1e-9))) - prior * np.mean(-np.log1p(-np.clip(sp, 0, 1 - 1e-9)))
        reg = decay * w
        reg[-1] = 0
        return (prior * pos + neg if risk >= 0 else -neg) + reg

    return _adam(grad, xp.shape[1], steps, rate)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on the rows of smallest hashed doc_id among the positives of ``labels`` (doc_id, quality) and among ``docs``,
    held-out rows left out of both, one text for each id. The samples are bounded, so what reaches the driver is too. With
    no positives or no text the model gives every document the score of its prior."""
    bound_batches(docs.sparkSession)
    pos = labels.where(F.col("quality") == 1).where(~held_out).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positives).withColumn("positive", F.lit(1))
    # The unlabelled rows are picked by another hash, so they are no copy of the positives.
    unl = docs.where("doc_id is not null").where(~held_out).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(max_unlabelled).withColumn("positive", F.lit(0))
    picked = checkpointed(pos.unionByName(unl).distinct())
    # An id that many rows repeat gives one of its texts, so no id makes the sample grow.
    every = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    texts = every.groupBy("doc_id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    @arrow_udf("array<float>")
    def vector(text: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in text], pa.list_(pa.float32()))

    rows = texts.select("doc_id", "positive", vector("text").alias("x")).toPandas().sort_values(["positive", "doc_id"])
    if not len(rows) or rows["positive"].nunique() < 2:
        return Model(np.zeros(N_FEATURES + 1), 0.5)
    x = np.hstack([np.stack(rows["x"].to_numpy()).astype(np.float64), np.ones((len(rows), 1))])
    is_pos = rows["positive"].to_numpy() == 1
    xp, xu = x[is_pos], x[~is_pos]
    prior = estimate_prior(xp, xu)
    return Model(fit_nnpu(xp, xu, prior), prior)


def score_udf(model: Model):
    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in text], pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, **sizes: int) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs`` (doc_id, text, any others).

    ``held_out`` is a column over doc_id; rows for which it is true teach nothing. Only the text is scored. Null and
    empty texts get the score of a text without features. Repeated rows get equal scores. No rows: no rows.
    """
    model = train(docs, labels, held_out, **sizes)
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score_udf(model)("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_low_quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier predicts 0; all columns as they were, no join.

    Null texts are judged as empty ones; equal texts share their verdict, whatever their doc_id. No rows: no rows."""
    model = train(docs, labels, held_out)
    return docs.where(score_udf(model)(F.col("text")) >= threshold)
