"""Quality classifier by positive-unlabelled learning.

A linear scorer over text statistics is fitted by minimising the non-negative unbiased risk (logistic loss):

    pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives))

from trusted positives (label 1) and unlabelled documents. Where the bracket turns negative, the step climbs out of it
instead. Known negatives are never used. The class prior pi is estimated from the same two samples: a scorer that tells
positives from unlabelled documents is fitted on one half; on the other half, the share of unlabelled documents above a
threshold over that of positives is at least pi, and comes down to pi where only positives are left (``class_prior``).

The fit takes at most about ``SAMPLE`` positives and ``SAMPLE`` unlabelled texts, picked by a hash of doc_id and text; copies
of a row count once, so what reaches the driver is bounded by ``SAMPLE`` feature rows. The held-out fold
(crc32(doc_id) mod 5 = 0) is in neither. Scoring is one pass over the whole texts of all rows.

Defined results: null and empty texts are scored like a text without words; a very long text is scored whole; repeated
rows are each scored; without any positive every document scores 0.5; null labels are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, held_out, ship, table, trim

SAMPLE = 6000
PAIRS = 512
SIZE = 256 + PAIRS + 8
STEPS, PRIOR_STEPS, RATE, DECAY = 400, 100, 0.05, 1e-4
SURE = 0.1  # probability that the bounds of both shares fail


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text: bytes, hashed byte pairs, words, repeats, lines."""
    x = np.zeros(SIZE, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    if len(b):
        x[:256] = np.sqrt(np.bincount(b, minlength=256) / len(b))
    if len(b) > 1:
        pair = (b[:-1].astype(np.uint32) * np.uint32(40503) + b[1:] * np.uint32(2654435)) >> np.uint32(7)
        x[256 : 256 + PAIRS] = np.sqrt(np.bincount(pair % PAIRS, minlength=PAIRS) / (len(b) - 1))
    words = raw.split()
    lines = [s for s in raw.split(b"\n") if s]
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words[1:], words))
    x[-8:] = [
        np.log1p(len(words)), len(raw) / n / 10, len(set(words)) / n, same / n, np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), max(map(len, words), default=0) / 100, len(words) == 0,
    ]
    return x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-10, 10) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def _score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positive part of the risk, the bracket, and the direction to go down: the gradient of the risk, or of the
    bracket's opposite where it is negative. ``w`` ends with the bias."""
    gp, gu = _score(p, w), _score(u, w)
    sp, su = 1 / (1 + np.exp(-gp.clip(-30, 30))), 1 / (1 + np.exp(-gu.clip(-30, 30)))
    positive = prior * float(np.logaddexp(0, -gp).mean())
    bracket = float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())
    # derivatives by the score: of l(g) sigma - 1, of l(-g) sigma
    dp, du = -prior * sp / len(p), su / len(u)
    if bracket >= 0:
        dp = dp + prior * (sp - 1) / len(p)
    else:
        dp, du = -dp, -du
    return positive, bracket, np.append(dp @ p + du @ u, dp.sum() + du.sum())


def _apart(w: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gradient of the logistic loss of telling positives from unlabelled documents, both sides weighted alike."""
    dp, du = -0.5 / len(p) / (1 + np.exp(_score(p, w).clip(-30, 30))), 0.5 / len(u) / (1 + np.exp(-_score(u, w).clip(-30, 30)))
    return np.append(dp @ p + du @ u, dp.sum() + du.sum())


def _adam(gradient, size: int, steps: int) -> np.ndarray:
    """Full batch, deterministic."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        grad = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled: the best bin of scores that were not fitted on. A threshold with few
    positives above it is penalised by the uncertainty of both shares."""
    if min(len(p), len(u)) < 20:
        return 0.5
    w = _adam(lambda w: _apart(w, p[::2], u[::2]), p.shape[1] + 1, PRIOR_STEPS)
    gp, gu = np.sort(_score(p[1::2], w)), np.sort(_score(u[1::2], w))
    above = 1 - np.arange(len(gp)) / len(gp)  # share of positives at or above each one of them
    share = 1 - np.searchsorted(gu, gp, side="left") / len(gu)
    doubt = np.sqrt(np.log(4 / SURE) / 2 / len(gp)) + np.sqrt(np.log(4 / SURE) / 2 / len(gu))
    best = int(np.argmin((share + doubt) / above))
    return float(np.clip(share[best] / above[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Non-negative unbiased risk minimisation; the prior is estimated unless it is given."""
    if not len(positive):
        return Model(np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, prior or 0.0)
    unlabelled = unlabelled if len(unlabelled) else positive
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (((v - mean) / scale).clip(-10, 10).astype(np.float32) for v in (positive, unlabelled))
    prior = class_prior(p, u) if prior is None else prior
    w = _adam(lambda w: risk(w, p, u, prior)[2], SIZE + 1, STEPS)
    return Model(mean, scale, w[:-1].astype(np.float32), float(w[-1]), prior)


def bounded(ids: DataFrame, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of ``ids`` at most, picked by a hash of doc_id."""
    share = min(1.0, bound / max(1, ids.count()))
    return ids.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def _matrix(docs: DataFrame, bound: int, seed: int) -> np.ndarray:
    """Features of about ``bound`` texts at most, picked by a hash; copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["h"], pa.array([features(t.as_py()).tobytes() for t in b["text"]], pa.binary())], ["h", "x"])
        trim()

    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    share = min(1.0, bound / max(1, docs.count()))
    some = docs.withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = some.select("h", "text").mapInArrow(run, "h long, x binary").groupBy("h").agg(F.min("x").alias("x")).orderBy("h")
    return np.frombuffer(b"".join(rows.toArrow()["x"].to_pylist()), np.float32).reshape(-1, SIZE)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, quality); of the labels only the positives are looked at."""
    good = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id")
    some = bounded(good, sample, 1).distinct()
    positive = _matrix(docs.join(F.broadcast(some), "doc_id", "left_semi"), sample, 1)
    unlabelled = _matrix(docs.where(~held_out(F.col("doc_id"))), sample, 2)
    return fit(positive, unlabelled)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, "text", 1024):
            x = np.stack([features(t.as_py()) for t in part["text"]])
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(model.score(x).astype(np.float64))], ["doc_id", "score"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, at_least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents that score ``at_least`` so much, with all their columns; one pass, no join."""
    model = train(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = np.concatenate([model.score(np.stack([features(t.as_py()) for t in b.column(at).slice(i, 1024)])) for i in range(0, b.num_rows, 1024)])
                yield b.filter(pa.array(ok >= at_least))
        trim()

    return docs.mapInArrow(run, docs.schema)


ship(__name__)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
