"""Quality classifier by positive-unlabelled learning.

A logistic score over text statistics is fitted by minimising the non-negative
unbiased risk: with trusted positives P, unlabelled texts U and class prior
``pi``, the risk is ``pi * R(P, +) + max(0, R(U, -) - pi * R(P, -))``.  When the
bracket turns negative the step descends it upwards instead, as the
non-negative estimator prescribes.  Judged negatives are never used.  The class prior is estimated
from P and U: whatever region R of statistics is taken, U holds at least ``pi``
times the share of R that P does, so ``pi`` is at most U(R) / P(R), and the
least such ratio over half-spaces is taken: of single statistics first, then
of the score fitted with the prior so far, ``ROUNDS`` times.  An estimate from
above makes the bracket negative on P-like texts and stops the fit early, so
``CAUTION`` times the estimate is used.

Statistics come from whole texts, in one vectorised pass that also serves the
scores.  Fitting takes about ``SAMPLE`` positives and ``SAMPLE`` unlabelled rows
at most, those below a cut of the id hash that follows from their count: a
documented bound, so tasks send and the driver holds a few megabytes at any
size.  Everything else covers all rows.

Defined results: null or word-less texts are scored from zero statistics;
without any trusted positive every score is 0.5; repeated rows get the same
score; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, spread
from .textscan import NOT_SPACE, R, byte_class, chunks, kgrams, mix, words

SAMPLE = 50_000
FOLDS = 5
STEPS = 600
RATE = 0.05
RIDGE = 1e-4
ROUNDS = 3
CAUTION = 0.9
CUT = 0.3
FEATURES = ["symbols", "symbols5", "upper", "upper5", "same_next", "same_next5", "repeated", "repeated5", "dup_lines", "variety", "word_length", "digits", "length", "wide"]

_LINE = byte_class([(0x0A, 0x0A)])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_HIGH = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)


def _per_doc(flags: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[edge[1:]] - total[edge[:-1]]).astype(float)


def _again(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which codes occur twice or more in their document."""
    _, back, n = np.unique(mix(code + doc.astype(np.uint64) * R), return_inverse=True, return_counts=True)
    return n[back] > 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` for every text, all within 0 and 1."""
    buf = b"\n".join(texts) + b"\n"
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    raw = np.frombuffer(buf, dtype=np.uint8)
    at = np.arange(len(texts))
    start, stop, h = words(buf, NOT_SPACE)
    first = np.searchsorted(start, edge)
    doc = np.repeat(at, np.diff(first))
    n = np.diff(first).astype(float)
    line_start, _, lines = words(buf, _LINE)
    line_first = np.searchsorted(line_start, edge)
    line_doc = np.repeat(at, np.diff(line_first))
    grams = kgrams(h, 3)
    inside = doc[: len(grams)] == doc[2:] if len(grams) else np.zeros(0, bool)
    share = lambda x, y: np.minimum(1.0, x / np.maximum(1.0, y))
    repeated = np.zeros(len(h), dtype=bool)
    repeated[: len(grams)][inside] = _again(grams[inside], doc[: len(grams)][inside])
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    _, one = np.unique(mix(h + doc.astype(np.uint64) * R), return_index=True)
    _, one_line = np.unique(mix(lines + line_doc.astype(np.uint64) * R), return_index=True)
    bytes_ = (stop - start).astype(float)
    size = np.bincount(doc, weights=bytes_, minlength=len(texts))
    accented = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3)
    upper = _per_doc(_UPPER[raw], edge) + _per_doc(np.append(accented, False), edge)
    n_lines = np.diff(line_first).astype(float)
    symbols, upper, same_, repeated_ = share(_per_doc(_SYMBOL[raw], edge), n), share(upper, size), share(_per_doc(same, first), n), share(_per_doc(repeated, first), n)
    return np.stack([
        symbols, np.minimum(1, 5 * symbols), upper, np.minimum(1, 5 * upper), same_, np.minimum(1, 5 * same_), repeated_, np.minimum(1, 5 * repeated_),
        share(n_lines - np.bincount(line_doc[one_line], minlength=len(texts)), n_lines), share(np.bincount(doc[one], minlength=len(texts)).astype(float), n),
        np.minimum(1, size / np.maximum(1, n) / 20), share(_per_doc(_DIGIT[raw], edge), size), np.minimum(1, np.log1p(n) / 12), share(_per_doc(_HIGH[raw], edge), size),
    ], axis=1)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every row of ``docs(doc_id, text)``."""

    def run(batches):
        for ids, texts in chunks(batches):
            x = statistics(texts).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), flat], names=["doc_id", "x"])

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, x array<float>")


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def minimise(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights (bias last) of least non-negative risk, over rows scaled to zero mean and unit spread."""
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.logaddexp(0, -z)
    for step in range(1, STEPS + 1):
        zp, zu = p @ w, u @ w
        rest = loss(-zu).mean() - prior * loss(-zp).mean()
        d_rest = squash(zu) @ u / len(u) - prior * (squash(zp) @ p) / len(p)
        grad = -prior * ((1 - squash(zp)) @ p) / len(p) + d_rest if rest >= 0 else -d_rest
        grad = grad + RIDGE * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Least U(R) / P(R) over half-spaces R that hold half of P or more, by single statistics."""
    least = 1.0
    for j in range(p.shape[1]):
        a, b = np.sort(p[:, j]), np.sort(u[:, j])
        for cut in np.unique(np.quantile(a, np.linspace(0, 1, 101))):
            for in_p, in_u in ((np.searchsorted(a, cut, "right"), np.searchsorted(b, cut, "right")), (len(a) - np.searchsorted(a, cut), len(b) - np.searchsorted(b, cut))):
                if 2 * in_p >= len(a):
                    least = min(least, (in_u + 1) / (len(b) + 1) * len(a) / in_p)
    return least


class Model:
    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray):
        self.known = len(positives) > 0 and len(unlabelled) > 0
        if self.known:
            both = np.concatenate([positives, unlabelled])
            self.mean, self.spread = both.mean(axis=0), both.std(axis=0) + 1e-3
            p, u = self.scaled(positives), self.scaled(unlabelled)
            prior = class_prior(positives, unlabelled)
            for _ in range(ROUNDS):
                self.w = minimise(p, u, CAUTION * prior)
                prior = min(prior, class_prior((p @ self.w)[:, None], (u @ self.w)[:, None]))
            self.prior = prior

    def scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scaled(x) @ self.w, -40, 40))) if self.known else np.full(len(x), 0.5)


def fit(table: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``table(doc_id, x)`` and ``labels(doc_id, quality)``, rows of fold 0 left out."""
    judged = labels.where((fold() != 0) & F.col("quality").isNotNull()).select("doc_id", "quality")

    def take(df):
        share = sample / max(1, df.count())
        chosen = df if share >= 1 else df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        return np.asarray(chosen.select("x").toArrow().column(0).combine_chunks().flatten(), dtype=float).reshape(-1, len(FEATURES))

    training = table.where((fold() != 0) & F.col("doc_id").isNotNull())
    positives = take(training.join(judged.where("quality = 1").select("doc_id").distinct(), "doc_id"))
    return Model(positives, take(training))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``."""
    table = materialize(features(docs), "features")
    model = table.sparkSession.sparkContext.broadcast(fit(table, labels, sample))

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=float).reshape(-1, len(FEATURES))
            if len(x):
                s = model.value.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_puquality(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole ``documents`` table."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
