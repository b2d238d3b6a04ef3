"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic. A token's emission is a sum of the weights of the word, its prefixes, and the words
beside it; two-by-two transition weights tie neighbours. Forward-backward marginals give each token's probability;
they aggregate to the document score by a logistic over the largest marginal, the expected number of toxic tokens
and their share; runs of tokens of at least one half are the offending spans (code point offsets).

Token labels are derived from the document labels of the training fold: in a toxic document, tokens are toxic whose
word or prefix is in significantly more of the toxic than of the clean documents (G test; copies count once). So the
words of a rare language need only enough documents of their own, not a share of all. A toxic document without such a
token is not taught as clean; it only counts for the document score. The fit takes at most about ``SAMPLE``
toxic and ``SAMPLE`` clean labelled doc_ids, picked by a hash, one text of each, and ``SAMPLE_BYTES`` of texts;
crc32(doc_id) mod 5 = 0 is held out.

Texts are packed by tokens, ``CELLS`` at a time; a text of more than ``SPAN`` tokens is cut into blocks that pass their
messages on, so that it costs no more memory or steps per token than others.

Defined results: null and empty texts have no tokens and score like a clean text; without a toxic training row every
document scores the same low value; repeated rows are each scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups, held_out, ship, table, trim
from .quality import bounded

SAMPLE = 1500
PREFIXES = (4, 5, 6)
WIDTH = len(PREFIXES) + 1  # features of a word for its own token
MIN_DOCS = 12
SURE, LIFT = 27.0, 4.0  # of a toxic mark: log likelihood ratio (chi square; one chance in 5 million), toxic to clean share
SEGMENT = 256  # tokens of a training sequence
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.3, 1e-4
SAMPLE_BYTES = 64 << 20
SPAN = 2048
CELLS = 1 << 20
WORDS_KEPT = 200_000
WORD = re.compile(r"[^\W\d_]+")
TRANSITIONS = ((0, 0), (0, 1), (1, 0), (1, 1))


def tokens(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text or "")]


def word_keys(word: str) -> list[str]:
    """Features of a word that count for the word itself."""
    return [f"w {word}", *[f"{n} {word[:n]}" for n in PREFIXES if len(word) >= n]]


@dataclass
class Model:
    vocabulary: dict[str, int]  # features that enough training documents hold, and toxic marks
    weights: np.ndarray  # of the toxic state against the clean one; the last is 0 and stands for no feature
    bias: float
    moves: np.ndarray  # 2 x 2, log
    head: np.ndarray  # logistic over document aggregates

    def slots(self, word: str) -> list[int]:
        """Weight slots of a word for its own token (padded), for the token after and for the one before it."""
        get, none = self.vocabulary.get, len(self.weights) - 1
        own = [get(k, none) for k in word_keys(word)]
        return [*own, *[none] * (WIDTH - len(own)), get("< " + word, none), get("> " + word, none)]

    def word(self, word: str) -> tuple[float, float, float]:
        s = self.slots(word)
        return float(self.weights[s[:WIDTH]].sum()), float(self.weights[s[-2]]), float(self.weights[s[-1]])

    def score(self, aggregates: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(aggregates @ self.head[:-1] + self.head[-1]).clip(-30, 30)))


class Scorer:
    """Emissions with a bounded cache of words, kept in a worker."""

    def __init__(self, model: Model):
        self.m = model
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.values: list[tuple[float, float, float]] = []
        self.known, self.filled = np.empty((1024, 3)), 0

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > WORDS_KEPT:
            self.clear()
        for w in {w for w in words if w not in self.ids}:
            self.ids[w] = len(self.values)
            self.values.append(self.m.word(w))
        v = self._table()[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))]
        e = v[:, 0] + self.m.bias
        e[1:] += v[:-1, 1]
        e[:-1] += v[1:, 2]
        return e

    def _table(self) -> np.ndarray:
        """The values as an array that grows by doubling."""
        if len(self.known) < len(self.values):
            self.known = np.concatenate([self.known, np.empty((len(self.values), 3))])
        if self.filled < len(self.values):
            self.known[self.filled : len(self.values)] = self.values[self.filled :]
            self.filled = len(self.values)
        return self.known


def forward_backward(e: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per sequence the marginals of the toxic state, and the ratios toxic to clean of the forward and backward messages."""
    fs, bs = [None] * len(e), [None] * len(e)
    for part in packed([len(x) for x in e]):
        for i, f, b in zip(part, *(_together([e[i] for i in part], moves) if len(e[part[0]]) <= SPAN else _blocks(e[part[0]], moves)), strict=True):
            fs[i], bs[i] = f, b
    p = []
    for f, b in zip(fs, bs, strict=True):
        odds = f * b
        p.append(odds / (1 + odds))
    return p, fs, bs


def packed(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of sequences, the longest first, by groups of ``CELLS`` tokens after padding; one longer than ``SPAN`` is
    alone."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist()
    at = 0
    while at < len(order):
        longest = sizes[order[at]]
        n = 1 if longest > SPAN else max(1, CELLS // max(1, longest))
        yield order[at : at + n]
        at += n


def _together(e: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Forward and backward ratios of sequences, the longest first, step by step together."""
    size = np.asarray([len(x) for x in e])
    top = int(size[0])
    r = np.zeros((top, len(e)))
    for k, x in enumerate(e):
        r[: size[k], k] = x
    np.exp(r.clip(-60, 60, out=r), out=r)
    (oo, ot), (to, tt) = np.exp(moves)
    f, b = np.empty_like(r), np.ones_like(r)
    live = np.searchsorted(-size, -np.arange(top), side="left")  # sequences longer than t
    for t in range(top):
        n = live[t]
        f[t, :n] = r[t, :n] if t == 0 else r[t, :n] * ((ot + f[t - 1, :n] * tt) / (oo + f[t - 1, :n] * to))
    for t in range(top - 2, -1, -1):
        n = live[t + 1]
        x = r[t + 1, :n] * b[t + 1, :n]
        b[t, :n] = (to + tt * x) / (oo + ot * x)
    return [f[:n, k] for k, n in enumerate(size)], [b[:n, k] for k, n in enumerate(size)]


def _blocks(e: np.ndarray, moves: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same for one long sequence, in blocks. A step turns a ratio x into (p x + q) / (s x + t); the steps of a block
    make one such map (a product of matrices), the maps give the ratio that enters each block, and the blocks then
    go on together."""
    n = len(e)
    width = int(np.ceil(np.sqrt(n)))
    k = -(-n // width)
    r = np.exp(e.clip(-60, 60))
    (oo, ot), (to, tt) = np.exp(moves)

    def chain(steps: np.ndarray, enter: float) -> np.ndarray:
        """The ratio after each step; ``steps`` is (n, 2, 2)."""
        m = np.concatenate([steps, np.broadcast_to(np.eye(2), (k * width - n, 2, 2))]).reshape(k, width, 2, 2)
        whole = np.broadcast_to(np.eye(2), (k, 2, 2))
        for j in range(width):
            whole = m[:, j] @ whole
            whole = whole / whole.max(axis=(1, 2), keepdims=True)
        x = np.empty(k)
        for i in range(k):
            x[i] = enter
            enter = (whole[i, 0, 0] * enter + whole[i, 0, 1]) / (whole[i, 1, 0] * enter + whole[i, 1, 1])
        out = np.empty((k, width))
        for j in range(width):
            x = (m[:, j, 0, 0] * x + m[:, j, 0, 1]) / (m[:, j, 1, 0] * x + m[:, j, 1, 1])
            out[:, j] = x
        return out.ravel()[:n]

    ones = np.ones(n)
    first = np.stack([np.stack([tt * r, ot * r], 1), np.stack([to * ones, oo * ones], 1)], 1)
    first[0] = [[0, r[0]], [0, 1]]
    last = np.stack([np.stack([tt * r, to * ones], 1), np.stack([ot * r, oo * ones], 1)], 1)[:0:-1]
    last = np.concatenate([np.eye(2)[None], last])  # b of the last token is 1
    return [chain(first, 1.0)], [chain(last, 1.0)[::-1]]


def aggregate(p: np.ndarray) -> list[float]:
    """What the document score is made of."""
    return [float(p.max()), float(np.log1p(p.sum())), float(np.sqrt(p.mean()))] if len(p) else [0.0, 0.0, 0.0]


def copy_key(words: list[str]) -> int:
    """Alike for copies and mostly for near copies: the smallest hash of three words in a row."""
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))


def feature_counts(docs: list[list[str]], toxic: np.ndarray) -> tuple[Counter, Counter]:
    """In how many clean and toxic documents each word feature is."""
    words, seen = (Counter(), Counter()), (Counter(), Counter())
    for d, y in zip(docs, toxic, strict=True):
        words[int(y)].update(set(d))
        seen[int(y)].update({k for w in set(d) for k in word_keys(w)[1:]})
    for c, s in zip(words, seen, strict=True):
        s.update({f"w {w}": n for w, n in c.items()})
    return seen


def toxic_marks(docs: list[list[str]], toxic: np.ndarray) -> set[str]:
    """The word features that are in significantly more of the toxic than of the clean documents."""
    one = {(copy_key(d), bool(y)): i for i, (d, y) in enumerate(zip(docs, toxic, strict=True))}
    some = sorted(one.values())
    clean, foul = feature_counts([docs[i] for i in some], toxic[some])
    n_toxic = max(1, int(toxic[some].sum()))
    n_clean = max(1, len(some) - n_toxic)
    share = n_toxic / (n_toxic + n_clean)

    def sure(a: int, b: int) -> bool:
        g = a * np.log(a / (a + b) / share) + (b * np.log(b / (a + b) / (1 - share)) if b else 0.0)
        return a * n_clean >= LIFT * b * n_toxic and 2 * g >= SURE

    return {k for k, n in foul.items() if sure(n, clean[k])}


def token_labels(docs: list[list[str]], toxic: np.ndarray, marks: set[str]) -> list[np.ndarray]:
    """Labels of tokens from labels of documents."""
    memo: dict[str, bool] = {}

    def mark(w: str) -> bool:
        if w not in memo:
            memo[w] = any(k in marks for k in word_keys(w))
        return memo[w]

    return [np.fromiter(map(mark, words), bool, len(words)) if y else np.zeros(len(words), bool) for words, y in zip(docs, toxic, strict=True)]


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Conditional log likelihood of the token labels by stochastic gradient ascent (Adagrad); then the head."""
    toxic = toxic.astype(bool)
    moves, head = np.asarray([[1.0, -1.0], [-1.0, 1.0]]), np.asarray([8.0, 0.0, 0.0, -4.0])
    if not toxic.any():
        return Model({}, np.zeros(1, np.float32), -4.0, moves, head)
    docs = [tokens(t) for t in texts]
    seen = feature_counts(docs, toxic)
    marks = toxic_marks(docs, toxic)
    labels = token_labels(docs, toxic, marks)
    total = seen[0] + seen[1]
    kept = sorted(k for k, n in total.items() if n >= MIN_DOCS or k in marks)
    kept += [f"{side} {k[2:]}" for k in kept if k[0] == "w" for side in "<>"]
    model = Model({k: i for i, k in enumerate(kept)}, np.zeros(len(kept) + 1), -4.0, moves, head)
    ids: dict[str, int] = {}
    for d in docs:
        for w in d:
            ids.setdefault(w, len(ids))
    slots = np.asarray([model.slots(w) for w in ids], np.int64)
    packed = [slots[np.fromiter(map(ids.__getitem__, d), np.int64, len(d))] if d else np.empty((0, WIDTH + 2), np.int64) for d in docs]

    def emissions(s: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
        x = w[s[:, :WIDTH]].sum(axis=1) + bias
        x[1:] += w[s[:-1, -2]]
        x[:-1] += w[s[1:, -1]]
        return x

    w, extra = model.weights, np.asarray([model.bias, *moves.ravel()])
    g2, extra2 = np.full(len(w), 1e-4), np.full(5, 1e-2)
    taught = [i for i, y in enumerate(toxic) if labels[i].any() or not y]
    cuts = [(i, at) for i in taught for at in range(0, len(docs[i]), SEGMENT)]
    order = [cuts[k] for k in np.argsort([xxhash.xxh3_64_intdigest(f"{i} {at}") for i, at in cuts], kind="stable")]
    for _ in range(EPOCHS):
        for at in range(0, len(order), BATCH):
            part = [(packed[i][k : k + SEGMENT], labels[i][k : k + SEGMENT]) for i, k in order[at : at + BATCH]]
            e = [emissions(s, w, extra[0]) for s, _ in part]
            m = np.exp(extra[1:].reshape(2, 2))
            rows, vals, ge = [], [], np.zeros(5)
            for (s, y), pi, fi, bi, ei in zip(part, *forward_backward(e, extra[1:].reshape(2, 2)), e, strict=True):
                d = y - pi
                rows += [s[:, :WIDTH].ravel(), s[:-1, -2], s[1:, -1]]
                vals += [np.repeat(d, WIDTH), d[1:], d[:-1]]
                ge[0] += d.sum()
                x = np.exp(ei[1:].clip(-60, 60)) * bi[1:]
                joint = np.stack([np.full(len(x), m[0, 0]), m[0, 1] * x, m[1, 0] * fi[:-1], m[1, 1] * fi[:-1] * x])
                joint /= joint.sum(axis=0)
                for k, (u, v) in enumerate(TRANSITIONS):
                    ge[1 + k] += ((y[:-1] == u) & (y[1:] == v)).sum() - joint[k].sum()
            g = np.bincount(np.concatenate(rows), np.concatenate(vals), len(w)) / len(part) - DECAY * w
            g[-1] = 0
            g2 += g * g
            w += RATE * g / np.sqrt(g2)
            extra2 += (ge / len(part)) ** 2
            extra = extra + 0.05 * (ge / len(part)) / np.sqrt(extra2)
    model.weights, model.bias, model.moves = w.astype(np.float32), float(extra[0]), extra[1:].reshape(2, 2)
    e = [emissions(s, w, extra[0]) for s in packed]
    a = np.asarray([aggregate(p) for p in forward_backward(e, model.moves)[0]])
    x = np.c_[a, np.ones(len(a))]
    for _ in range(2000):
        s = 1 / (1 + np.exp(-(x @ model.head).clip(-30, 30)))
        model.head = model.head + 2.0 * (x.T @ (toxic - s) / len(x) - 1e-4 * model.head)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). What reaches the driver is bounded: about ``sample`` doc_ids of
    either label, one text of each, in the order of a hash as far as all of them together have ``sample_bytes``."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("y"))
    some = bounded(known.where("y"), sample, 3).union(bounded(known.where("NOT y"), sample, 4))
    texts = docs.where("text IS NOT NULL").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = cut(texts.select("doc_id", "y", "text", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")), "sample")
    sizes = texts.select("h", "n").toArrow()
    order = np.argsort(sizes["h"].to_numpy(), kind="stable")
    inside = np.cumsum(sizes["n"].to_numpy()[order].astype(np.int64)) <= sample_bytes
    rows = texts.where(F.col("h") <= int(sizes["h"].to_numpy()[order[inside][-1]])).select("y", "text").toArrow() if inside.any() else texts.limit(0).select("y", "text").toArrow()
    pairs = sorted(zip(rows["y"].to_pylist(), rows["text"].to_pylist(), strict=True))
    return fit([t for _, t in pairs], np.asarray([y for y, _ in pairs], bool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, score, spans array<struct<begin,end>>)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # as large as the training sample's vocabulary

    def spans(text: str, p: np.ndarray) -> list[dict]:
        out: list[dict] = []
        last = -2
        for k, m in enumerate(WORD.finditer(text)):
            if p[k] >= 0.5:
                if out and last == k - 1:
                    out[-1]["end"] = m.end()
                else:
                    out.append({"begin": m.start(), "end": m.end()})
                last = k
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for part in groups(batches, "text"):
            texts = [t or "" for t in part["text"].to_pylist()]
            p = forward_backward([scorer.emissions(tokens(t)) for t in texts], sent.value.moves)[0]
            s = sent.value.score(np.asarray([aggregate(x) for x in p]))
            found = [spans(t, x) if len(x) and x.max() >= 0.5 else [] for t, x in zip(texts, p, strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(s, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "spans"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<begin:int,end:int>>")


ship(__name__)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
