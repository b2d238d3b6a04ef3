"""Pieces, top-k, token blocks, toxicity, near duplicates, quality."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from confluo.llm import near_dup, pieces, quality, token_store, topk, toxicity

P = pytest.importorskip("public_tokenizers")
ODD = ["", "a", " a  b ", "▁x▁ ▁", "é\n\n你好🙂", "a\x00b\x1c\x1d!", "don't <|endoftext|> it's", "x" * 3000, " " * 50, "\n \n  b"]


def test_pieces(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (None, "null key"), (1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    out = pieces.encode(df, pieces.model_path())
    got = {(r.doc_id, r.lossless): r for r in out.collect()}
    assert all(r.lossless in (True, None) for r in got.values()) and got[(90, None)].ids is None
    back = {r.doc_id: r.text for r in pieces.decode(out, pieces.model_path()).collect()}
    assert back == dict(rows)
    again = {r.doc_id: r.ids for r in pieces.encode(df.repartition(3), pieces.model_path()).collect()}
    assert again == {r.doc_id: r.ids for r in got.values()}
    assert pieces.encode(df.limit(0), pieces.model_path()).count() == 0


def test_piece_distribution():
    p = pieces.Pieces(pieces.model_path())
    vocab = {b.decode(): i for i, b in enumerate(p.bytes) if b and i not in set(p.byte_id)}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in vocab:
                yield from ((vocab[s[:k]], *w) for w in ways(s[k:]))

    weight = {w: np.exp(p.theta * sum(p.scores[i] for i in w)) for w in ways(" then")}
    total, n = sum(weight.values()), 20_000
    drawn = [tuple(x.tolist()) for x in p.sample(["then"] * n, list(range(n)))]
    for w, x in weight.items():
        assert abs(drawn.count(w) / n - x / total) < 0.015
    assert len(set(drawn)) > 3


@pytest.mark.parametrize("text", ["a   b", "it's", "x  ."])
def test_pieces_are_drawn_as_from_the_lattice_of_the_whole_text(text):
    p = pieces.Pieces(pieces.model_path())
    vocab = {b.decode(): i for i, b in enumerate(p.bytes) if b and i not in set(p.byte_id)}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in vocab:
                yield from ((vocab[s[:k]], *w) for w in ways(s[k:]))

    log = {w: p.theta * sum(p.scores[i] for i in w) for w in ways(" " + text)}
    weight = {w: np.exp(x - max(log.values())) for w, x in log.items()}
    total, n = sum(weight.values()), 20_000
    drawn = [tuple(x.tolist()) for x in p.sample([text] * n, list(range(n)))]
    assert set(drawn) <= weight.keys()
    for w, x in weight.items():
        assert abs(drawn.count(w) / n - x / total) < 0.015


def test_pieces_with_little_room(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abc déà,.\n 你▁") for _ in range(r.randrange(400))) for _ in range(200)] + ["a" * 40_000, " " * 40_000 + "b", "你好" * 9000]
    want = pieces.Pieces(pieces.model_path()).sample(texts, list(range(len(texts))))
    monkeypatch.setattr(pieces, "CHARS", 300)
    monkeypatch.setattr(pieces, "CHUNK", 100)
    p = pieces.Pieces(pieces.model_path(), kept=900)
    got = p.sample(texts, list(range(len(texts))))
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and [p.decode(x) for x in got] == texts
    assert p.nodes < 100_000 and len(p.units) < 200


def test_top_k(spark):
    r = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in r.normal(size=6).astype(np.float32)]) for i in range(400)]
    vecs += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (7, [0.5] * 6), (100, [0.1] * 6), (503, [float("inf")] * 6), (600, [2.0]), (601, [])]
    rows = topk.integers(spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)))
    ok = [(i, np.pad(np.floor(1024 * np.asarray(v, float)).astype(int), (0, 6 - len(v)))) for i, v in vecs if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = {}
    for x in topk.top_k(rows.where("id % 100 = 0"), rows, 10).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for q in {i for i, _ in ok if i % 100 == 0 and i != 100}:
        qv = next(v for i, v in ok if i == q)
        best = sorted((-int(v @ qv), i) for i, v in ok if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    one = [[(100, x) for x in sorted(((-int(v @ qv), i) for i, v in ok if i != 100))[:10]] for j, qv in ok if j == 100]
    want = sorted((k + 1, i, -s) for each in one for k, (_, (s, i)) in enumerate(each))
    assert len(one) == 2 and sorted(got[100]) == want  # two vectors of one id: a list each
    again = rows.union(rows.where("id = 200"))
    assert topk.top_k(again.where("id = 200"), again, 10).count() == 10  # the same row twice is one query
    assert topk.top_k(rows.limit(0), rows, 3).count() == 0


def test_early_stop_is_exact():
    r = np.random.default_rng(2)
    x = (r.standard_t(3, size=(3000, 32)) * 100).astype(np.int64)
    shard, proofs = topk.Shard(np.arange(3000), x), 0
    for i in range(20):
        ids, score, proved = shard.search(i, x[i], 10)
        full = [(-int(s), j) for j, s in enumerate(x @ x[i]) if j != i]
        assert [(-s, j) for s, j in zip(score.tolist(), ids.tolist(), strict=True)] == sorted(full)[:10]
        proofs += proved
    assert proofs > 0


def test_blocks():
    r = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        for high in (1, 2, 300, 50257, 2**31, 2**32):
            a = r.integers(0, high, n).astype(np.uint32)
            a[::17] = r.integers(0, 2**32 - 1, len(a[::17]))
            assert (token_store.unpack(*token_store.pack(a)) == a).all()
    payload, starts = token_store.pack(np.arange(1000, dtype=np.uint32))
    assert (token_store.unpack(payload, starts, 2, 3) == np.arange(256, 384)).all()


def test_token_store_starts_no_threads(spark, tmp_path):
    def count(batches):
        import numpy  # noqa: F401  which starts its own

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(os.listdir("/proc/self/task"))], pa.int64())], ["n"])

    def most():
        return spark.range(0, 64, 1, 4).mapInArrow(count, "n long").agg(F.max("n")).first()[0]

    before = most()
    docs = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(20)]).alias("text"))
    token_store.write(docs, f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"))
    assert most() == before


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(0)
    odd = ["".join(r.choice(list(" \n\t\r  ab'sé3$%你\xa0\x1c\x85.İ²,") + ["<|endoftext|>"]) for _ in range(r.randrange(30))) for _ in range(300)]
    rows = [(1000 - i, x) for i, x in enumerate(ODD + odd)] + [(3, None), (None, "z"), (1000, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = f"file://{tmp_path}/t"
    token_store.write(df, out, path)
    got = token_store.read(spark, out).orderBy("start").collect()
    assert len(got) == len(rows) and [x.doc_id for x in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    at = 0
    h = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    texts = sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], h[x[1]], x[1] or ""))
    for x, (_, text) in zip(got, texts, strict=True):
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize(("kept", "long"), [(100_000, 1 << 20), (60, 1 << 20), (100_000, 5)])
def test_encoder_against_the_tokenizer(monkeypatch, kept, long):
    monkeypatch.setattr(token_store, "LONG", long)
    e = token_store.Encoder(P.path("byte_bpe_50k.json"), kept)
    r = random.Random(kept + long)
    signs = [*" \n\t\r ab'sé3$%你.,²İ·´×÷’—🙂ñßªº", "'re", "'ll", "'ve", "'d", "'m", "'t", "don't", " they'll", "<|endoftext|>", "\xa0", "\x1c", "\x0b", "\x00", "q\x00", " " + "w" * 40]
    often = [5 if x in " ab's\n" else 1 for x in signs]
    for _ in range(40):
        texts = ["".join(r.choices(signs, often, k=r.randrange(40))) for _ in range(100)]
        for t, ids, want in zip(texts, e.encode(texts), e.t.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids.tolist() == want.ids, t
    assert e.known.n <= kept + 4000 and len(e.uses) == e.known.n


def test_token_numbers_are_exact():
    r = np.random.default_rng(1)
    t = token_store.Tokens(14)
    keys = np.unique(r.integers(0, 9, (9000, token_store.WORDS)).astype(np.uint64), axis=0)
    keys = r.permutation(keys)
    t.add(keys[:3000])
    t.add(keys[3000:4000])
    assert (t.find(keys[:4000]) == np.arange(4000)).all() and (t.find(keys[4000:]) == -1).all()


def shingle_set(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    docs, n = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 6, 8, 40, 120]))]
        for _ in range(r.choice([1, 2, 30])):
            w = [r.choice(vocab) if r.random() < 0.012 else x for x in base]
            docs.append((n := n + 1, " ".join(w)))
    docs += [(9000, None), (9001, ""), (9002, " \t"), (9003, "a b"), (9004, "A  b"), (None, "a b"), (1, docs[0][1])]
    sets = {d: shingle_set(t) for d, t in docs if d is not None}
    parent = {d: d for d in sets}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    out = near_dup.groups(df).collect()
    assert len(out) == len(docs)
    for x in out:
        if x.doc_id is not None:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), top(x.doc_id), top(x.doc_id) == x.doc_id)
        else:
            assert x.component_id is None and x.kept
    left = near_dup.dedup(df)
    assert left.columns == df.columns and sorted(x.doc_id for x in left.where("doc_id IS NOT NULL").collect()) == sorted({top(d) for d in sets})
    assert near_dup.groups(df.limit(0)).count() == 0


def test_dedup_of_a_repeated_id(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    docs = [(7, text("a"), 1), (7, text("b"), 2), (7, text("b").upper(), 2), (7, None, 3), (7, "", 3), (8, text("a"), 4), (3, text("c"), 5), (9, text("c") + " d", 6)]
    left = near_dup.dedup(spark.createDataFrame(docs, "doc_id long, text string, k int")).collect()
    assert sorted((x.doc_id, x.k) for x in left) == [(3, 5), (7, 1), (7, 2), (7, 3)]


def test_estimate():
    r = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.9):
        a = near_dup.mix(r.integers(0, 2**62, 4000).astype(np.uint64))
        k = int(4000 * share)
        b = np.unique(np.concatenate([a[:k], near_dup.mix(r.integers(0, 2**62, 4000 - k).astype(np.uint64))]))
        a = np.unique(a)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        e = near_dup.estimate(near_dup.sketch(a)[None], near_dup.sketch(b)[None])[0]
        assert abs(e - true) < 0.16


def _labelled(spark):
    r = random.Random(6)
    nice = [f"{a}{b}" for a in ("tor", "lin", "ves", "am", "pre") for b in ("en", "al", "ist", "o", "ing", "ed")]
    rows, labels = [], []
    for i in range(700):
        w = [r.choice(nice) for _ in range(r.randrange(20, 60))]
        bad, foul = i % 5 == 1, i % 4 == 2
        if foul:
            w[r.randrange(len(w))] = w[r.randrange(len(w))] = "zugwort" + r.choice(["a", "en", "st"])
        text = " ".join(w)
        rows.append((i, "$$ ".join(x.upper() for x in w) if bad else text))
        labels.append((i, int(not bad), int(foul)))
    rows += [(9001, None), (9002, ""), (9003, "torx " * 20_000), (5, "repeated row")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    return d, spark.createDataFrame([*labels, (4, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    docs, labels = _labelled(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    truth = {r.doc_id: r for r in labels.where("quality IS NOT NULL").collect()}
    q = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    x = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    t = {r.doc_id: r for r in x}
    test = [i for i in truth if held(i) and i != 5]
    assert np.mean([(q[i] >= 0.3) == truth[i].quality for i in test]) > 0.95
    assert np.mean([(t[i].score >= 0.5) == truth[i].toxic for i in test]) > 0.95
    foul = next(i for i in test if truth[i].toxic)
    text = docs.where(f"doc_id = {foul}").first().text
    assert any("zugwort" in text[s.begin : s.end].lower() for s in t[foul].spans)
    assert all(0 <= v <= 1 for v in q.values()) and all(0 <= r.score <= 1 for r in x) and len(x) == docs.count()
    assert t[9001].score == t[9002].score < 0.5 and t[9001].spans == []
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {5} == {i for i, s in q.items() if s >= 0.3} - {5}
    none = labels.where("quality = 0 AND toxic = 0")
    assert quality.score(docs, quality.train(docs, none)).where("score <> 0.5").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0


def test_toxic_words_of_a_minority():
    r = random.Random(8)
    nice = [f"{a}{b}" for a in ("tor", "lin", "ves", "am", "pre") for b in ("en", "al", "ist", "o", "ing", "ed")]
    text = lambda *foul: " ".join(r.sample([r.choice(nice) for _ in range(30)] + [*foul] * 2, 30 + 2 * len(foul)))
    few = lambda: text("krakel" + r.choice("abcdefgh"))
    copied = text("onlyhere")
    clean = [text() for _ in range(2800)]
    toxic = [text("zugwort") for _ in range(700)] + [few() for _ in range(11)] + [copied] * 40
    model = toxicity.fit(clean + toxic, np.asarray([0] * len(clean) + [1] * len(toxic)))
    marks = toxicity.toxic_marks([toxicity.tokens(t) for t in clean + toxic[:-40]], np.asarray([False] * 2800 + [True] * 711))
    assert "6 krakel" in marks and "w zugwort" in marks and not any(k[2:] in nice for k in marks)
    both = toxicity.toxic_marks([toxicity.tokens(t) for t in clean + toxic], np.asarray([False] * 2800 + [True] * 751))
    assert "w onlyhere" not in both  # copies of one document count once
    scorer = toxicity.Scorer(model)
    p = toxicity.forward_backward([scorer.emissions(toxicity.tokens(t)) for t in [few(), few(), text("zugwort"), text()]], model.moves)[0]
    s = model.score(np.asarray([toxicity.aggregate(x) for x in p]))
    assert (s[:3] >= 0.5).all() and s[3] < 0.5


def test_marginals_against_all_label_paths(monkeypatch):
    r = np.random.default_rng(5)
    moves = r.normal(size=(2, 2))
    e = [r.normal(size=n) * 3 for n in (1, 2, 5, 9, 0, 9)]

    def brute(x):
        total, toxic = 0.0, np.zeros(len(x))
        for path in np.ndindex(*[2] * len(x)):
            y = np.asarray(path, int)
            weight = np.exp((x * y).sum() + moves[y[:-1], y[1:]].sum())
            total, toxic = total + weight, toxic + weight * y
        return toxic / total

    for span, cells in ((2048, 1 << 20), (3, 4), (0, 1)):
        monkeypatch.setattr(toxicity, "SPAN", span)
        monkeypatch.setattr(toxicity, "CELLS", cells)
        for x, p in zip(e, toxicity.forward_backward(e, moves)[0], strict=True):
            assert np.allclose(p, brute(x) if len(x) else [], atol=1e-12)


def test_blocks_agree_with_steps(monkeypatch):
    r = np.random.default_rng(6)
    e = [r.normal(size=n) * 8 for n in (5000, 4097, 1_000_000)]
    moves = np.asarray([[2.0, -3.0], [-1.0, 1.5]])
    long = toxicity.forward_backward(e, moves)[0]
    monkeypatch.setattr(toxicity, "SPAN", 1 << 30)
    for a, b in zip(long, toxicity.forward_backward(e, moves)[0], strict=True):
        assert np.allclose(a, b, atol=1e-9)


def test_risk_gradient():
    r = np.random.default_rng(7)
    p, u = r.normal(size=(40, 5)) + 0.7, r.normal(size=(60, 5))
    for prior, side in ((0.3, 1), (0.95, -1)):
        w = r.normal(size=6) * (0.2 if side > 0 else 2)
        w = w if side > 0 else np.asarray([3.0] * 5 + [4.0])
        bracket = quality.risk(w, p, u, prior)[1]
        g = quality.risk(w, p, u, prior)[2]

        def value(w, prior=prior, bracket=bracket):
            a, b, _ = quality.risk(w, p, u, prior)
            return a + b if bracket >= 0 else -b

        for k in range(6):
            d = np.zeros(6)
            d[k] = 1e-3  # scores are of single precision
            assert abs((value(w + d) - value(w - d)) / 2e-3 - g[k]) < 2e-3
    gp, gu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    by_hand = np.mean(np.log1p(np.exp(gu))) - prior * np.mean(np.log1p(np.exp(gp)))
    assert abs(quality.risk(w, p, u, prior)[1] - by_hand) < 1e-6


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_needs_no_negatives(share):
    r = np.random.default_rng(8)
    good, bad = (lambda n: r.normal(size=(n, 6)) + 1.5), (lambda n: r.normal(size=(n, 6)) - 1.5)
    k = int(4000 * share)
    u = np.concatenate([good(k), bad(4000 - k)])
    assert abs(quality.class_prior(good(1500).astype(np.float32), r.permutation(u).astype(np.float32)) - share) < 0.06


def test_known_negatives_are_not_looked_at(spark):
    docs, labels = _labelled(spark)
    a = quality.train(docs, labels)
    b = quality.train(docs, labels.where("quality = 1"))
    assert np.allclose(a.weights, b.weights, atol=1e-3) and abs(a.prior - b.prior) < 1e-6
