"""Operator 10: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; the texts of the labelled rows of the training
folds, toxic or not, are unlabelled: what their label says is not used. Where labels
name toxic texts only, all training texts are. A linear classifier over word
presence starts from nothing and minimises the class-prior-corrected risk: the
positives' loss times the prior, plus what is left of the unlabelled texts' loss once
the positives' share is taken off. Where that rest falls below zero, which only
fitting too closely can do, a step is taken back up it instead. The prior is the share
of toxic rows among the labelled training rows, or less where the unlabelled texts
hold the positives' words more rarely than that.

Fitting is numpy on a sample in hash order, of ``positives`` and ``unlabelled``
labelled rows at most, as sets of words hashed to HASH_BITS bits; of these the
FEATURES that differ most are used. The prior covers all labels and the scores all
rows. The score's scale puts 0.7 where cross-fitted scores let expect the best F1.

Results for odd rows: a null or empty text has no words and gets the score of
the bias alone; without a positive to learn from every score is 0. A null doc_id
is not held out. Repeated rows are scored each, alike; texts of the same words
tie; of rows that repeat a doc_id in labels, one toxic row makes it toxic. An empty
table gives no rows. Other columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import text_rows, text_slices
from .bpe import Words
from .language import fold, words_of

#: Rows that are fitted on at most, of each kind; see the README.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Words are numbers below 2^HASH_BITS; the classifier uses the FEATURES that differ most.
HASH_BITS, FEATURES = 20, 400
#: Standard errors from which a word's difference is no chance find; and words that are used where there is none such.
SURE, LEAST_FEATURES = 3.0, 8
THRESHOLD = 0.7
STEPS, RATE, DECAY, FOLDS = 300, 0.05, 0.005, 4


def word_code(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode(), 7) & ((1 << HASH_BITS) - 1)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, mark, text) -> key, mark, codes of the distinct words."""
    cache = Words(word_code)
    for batch in text_slices(batches, 2):
        codes, found, ends = words_of(batch.column(2))
        words = found.to_pylist()
        table = np.array([cache[w] if w else -1 for w in words], np.int64)
        sets, at = [], 0
        for end in ends.tolist():
            own = np.unique(table[codes[at:end]]) if end > at else np.empty(0, np.int64)
            sets.append(own[own >= 0].astype(np.int32))
            at = end
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int32()))], ["key", "mark", "codes"])


def _sampled(docs: DataFrame, ids: DataFrame, limit: int) -> list[np.ndarray]:
    """Word sets of the texts of at most ``limit`` ids in hash order.

    Ids are chosen first, so the texts of the chosen alone are looked at and none
    is shuffled; the chosen ids are broadcast, ``limit`` longs at most."""
    key = F.xxhash64("doc_id")
    chosen = ids.select("doc_id").distinct().orderBy(key, "doc_id").limit(limit)
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(key.alias("key"), F.xxhash64("text").alias("mark"), "text")
    sets = rows.mapInArrow(_word_sets, "key long, mark long, codes array<int>").orderBy("key", "mark").limit(limit)
    return [np.asarray(r.codes, np.int64) for r in sets.collect()]


class Classifier:
    """sigmoid(scale * (bias + sum of the weights of the words) + offset)."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float, shift: float, scale: float):
        order = np.argsort(codes)
        self.codes, self.weights, self.bias, self.shift, self.scale = codes[order], weights[order], bias, shift, scale

    def weight(self, code: int) -> float:
        at = int(np.searchsorted(self.codes, code))
        return float(self.weights[at]) if at < len(self.codes) and self.codes[at] == code else 0.0

    def scores(self, logits: np.ndarray) -> np.ndarray:
        cut = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.scale * (logits + self.bias - self.shift) + cut, -60, 60)))


def _log_loss(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log(1 + exp(-z)) and its derivative."""
    return np.logaddexp(0, -z), -1 / (1 + np.exp(np.clip(z, -60, 60)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = STEPS, decay: float = DECAY, non_negative: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, from zero (Adam, whole batches)."""
    w, b = np.zeros(pos.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = pos @ w + b, unl @ w + b
        _, dp = _log_loss(zp)
        lp_neg, dp_neg = _log_loss(-zp)
        lu_neg, du_neg = _log_loss(-zu)
        rest = lu_neg.mean() - prior * lp_neg.mean()
        grad_rest = np.append(-(du_neg @ unl) / len(unl) + prior * (dp_neg @ pos) / len(pos), -du_neg.mean() + prior * dp_neg.mean())
        grad = prior * np.append(dp @ pos / len(pos), dp.mean()) + grad_rest
        if rest < 0 and non_negative:
            grad = -grad_rest
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _matrix(sets: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(codes)), np.float32)
    for i, own in enumerate(sets):
        at = np.searchsorted(codes, own)
        at[at == len(codes)] = 0
        out[i, at[codes[at] == own]] = 1
    return out


def _features(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """Codes whose shares among positives and unlabelled texts differ most, in standard errors."""
    size = 1 << HASH_BITS
    p, u = (np.bincount(np.concatenate([*x, np.empty(0, np.int64)]), minlength=size) for x in (pos, unl))
    share = (p + u + 1) / (len(pos) + len(unl) + 2)
    z = np.abs(p / len(pos) - u / len(unl)) / np.sqrt(share * (1 - share) * (1 / len(pos) + 1 / len(unl)))
    z[p + u < 2] = 0
    best = np.argsort(-z, kind="stable")[:FEATURES]
    sure = z[best] >= SURE
    return np.sort(best[sure] if sure.any() else best[:LEAST_FEATURES][z[best[:LEAST_FEATURES]] > 0])


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = STEPS) -> Classifier | None:
    fitted = lambda p, u: fit_nnpu(p, u, prior_among(p, u, prior), steps)
    if not pos or not unl:
        return None
    parts = min(FOLDS, len(pos))
    in_fold = lambda sets, k: [s for i, s in enumerate(sets) if i % parts == k]
    out_fold = lambda sets, k: [s for i, s in enumerate(sets) if i % parts != k]
    p_scores, u_scores = [], []
    for k in range(parts) if parts > 1 else ():
        a, b = out_fold(pos, k), out_fold(unl, k) or unl
        codes = _features(a, b)
        w, bias = fitted(_matrix(a, codes), _matrix(b, codes))
        p_scores.append(_matrix(in_fold(pos, k), codes) @ w + bias)
        u_scores.append(_matrix(in_fold(unl, k), codes) @ w + bias)
    codes = _features(pos, unl)
    w, bias = fitted(_matrix(pos, codes), _matrix(unl, codes))
    shift = best_cut(np.concatenate(p_scores), np.concatenate(u_scores), prior_among(_matrix(pos, codes), _matrix(unl, codes), prior)) if p_scores else 0.0
    return Classifier(codes, w, bias, shift, 1.0)


def prior_among(pos: np.ndarray, unl: np.ndarray, share: float) -> float:
    """The class prior of the unlabelled texts: the labelled rows' toxic share,
    unless the words of positives show that fewer are toxic here. A word that only
    toxic texts hold is among all texts the prior times as frequent as among
    positives; the median word, by its frequency among positives, is taken."""
    p, u = pos.mean(0), unl.mean(0)
    signs = p > u
    if not signs.any():
        return share
    ratio, weight = u[signs] / p[signs], p[signs]
    order = np.argsort(ratio)
    middle = np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)
    return float(min(share, max(ratio[order][middle], 1 / len(unl))))


def best_cut(pos: np.ndarray, unl: np.ndarray, prior: float) -> float:
    """The logit of the best F1 that positives and unlabelled texts let expect:
    prior times recall are hits, the unlabelled share above is what is flagged.
    It lies in the middle between the two scores around it."""
    both = np.unique(np.concatenate([pos, unl]))
    if len(both) < 2:
        return float(both[0]) if len(both) else 0.0
    cuts = (both[1:] + both[:-1]) / 2
    recall = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    above = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    return float(cuts[np.argmax(np.minimum(prior * recall, above) / (prior + above))])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, parts: int = 3, held: int = 1) -> Classifier | None:
    """Fit on rows out of the held-out fold. docs: doc_id, text; labels: doc_id, toxic."""
    open_docs = docs.filter(fold("doc_id", parts) != held)
    marked = labels.filter((fold("doc_id", parts) != held) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = marked.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    ids = lambda rows: open_docs.select("doc_id").join(rows.select("doc_id"), "doc_id", "left_semi")
    return fit(_sampled(open_docs, ids(marked.filter("toxic = 1")), positives), _sampled(open_docs, ids(marked) if prior < 1 else open_docs, unlabelled), min(prior, 0.95))


def _score_batches(batches: Iterator[pa.RecordBatch], model: Classifier | None) -> Iterator[pa.RecordBatch]:
    cache = Words(lambda w: model.weight(word_code(w)) if w else 0.0)
    for batch in text_slices(batches, 2):
        if model is None:
            scores = np.zeros(batch.num_rows)
        else:
            codes, found, ends = words_of(batch.column(2))
            words = found.to_pylist()
            weights = np.array([cache[w] for w in words])
            logits = np.zeros(len(ends))
            hot = np.flatnonzero(weights)
            if len(hot):
                # Each word once a text: only words with a weight are looked at.
                at = np.flatnonzero(weights[codes] != 0)
                rows = np.searchsorted(ends, at, "right")
                pairs = np.unique(rows * len(weights) + codes[at])
                logits = np.bincount(pairs // len(weights), weights[pairs % len(weights)], len(ends))
            scores = model.scores(logits)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
        )


def score(docs: DataFrame, model: Classifier | None, parts: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights
    rows = text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, parts) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _score_batches(b, shared.value), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    rows = text_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return score(rows, train(spark, rows, marks))
