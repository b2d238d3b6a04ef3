"""The stages of the corpus pipeline, each against a plain version of it on what the stage before kept."""

import random

import pytest
from pyspark.sql import functions as F
from test_free_operators import shingle_set
from test_native_operators import words
from test_pseudonyms import KEY, brute

import corpus_pipeline
from confluo.llm import pieces, pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids int"
LEAK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    nice = [f"{a}{b}" for a in ("tor", "lin", "ves", "am", "pre") for b in ("en", "al", "ist", "o", "ing", "ed")]
    said = lambda n: " ".join(r.choice(nice) for _ in range(n))
    docs, labels = [], []
    for i in range(420):
        bad = i % 5 == 1
        text = said(r.randrange(30, 70))
        docs.append((i, "$$ ".join(x.upper() for x in text.split()) if bad else text))
        labels.append((i, int(not bad), 0))
    docs[2] = (2, said(300) + " " + LEAK.upper() + ". " + said(300))  # a passage in a long document
    docs[3] = (3, said(20) + " " + LEAK)  # mostly benchmark
    docs[4] = (4, said(30) + " card 4041894974608795, mail a.b@mail.example.com, tel +1 (988) 555-2485 and 1984-02-29")
    long = said(2_000)
    docs += [(500, docs[0][1]), (501, docs[0][1] + " more"), (502, None), (503, ""), (0, docs[0][1]), (None, said(40)), (None, None), (504, long), (505, long + " x")]
    labels += [(7, None, None), (0, 1, 0)]
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", None if t is None else len(t), "clash", 1) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.conf.set(pii.KEY_CONF, KEY)
    yield at
    spark.conf.unset(pii.KEY_CONF)


def staged(spark, at, out, docs):
    held = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{out}/{name}")
        docs = held[name] = spark.read.parquet(f"{out}/{name}")
    return held


def test_stages(spark, folder, tmp_path):
    held = staged(spark, folder, str(tmp_path), spark.read.parquet(f"{folder}/documents.parquet"))
    rows = {k: v.collect() for k, v in held.items()}
    before, good, one, clean, private, last = (rows[k] for k in ("documents", "quality", "near_dup", "decontaminate", "pii", "pieces"))
    assert all(held[k].columns == held["documents"].columns for k in ("quality", "near_dup", "decontaminate", "pii"))
    # quality: shouting is dropped, prose stays
    ids = {r.doc_id for r in good}
    prose = [i for i in range(420) if i % 5 != 1]
    assert sum(i in ids for i in prose) >= 0.99 * len(prose) and sum(i in ids for i in range(420) if i % 5 == 1) <= 2 and not set(good) - set(before)
    # near duplicates: the smallest of each component, and all rows without an id
    sets = {r.doc_id: shingle_set(r.text) for r in good if r.doc_id is not None}
    keys, top = sorted(sets), {d: d for d in sets}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top[a], top[b]
                top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    assert sorted(r.doc_id for r in one if r.doc_id is not None) == sorted({v for v in top.values()})
    assert sum(r.doc_id is None for r in one) == sum(r.doc_id is None for r in good) and not set(one) - set(good)
    # decontamination: documents full of windows go, the others lose them and nothing else
    grams = {tuple(words(LEAK)[i : i + 13]) for i in range(2)}

    def hit(t):
        w = words(t)
        return {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in grams for j in range(i, i + 13)}

    want = {r.doc_id: [w for i, w in enumerate(words(r.text)) if i not in hit(r.text)] for r in one if 20 * len(hit(r.text)) < max(1, len(words(r.text)))}
    got = {r.doc_id: r for r in clean}
    assert {k: words(r.text) for k, r in got.items()} == want and 3 not in got and 2 in got
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean)
    same = {r for r in one if not hit(r.text)}
    assert same <= set(clean)
    # personal data, and pieces
    assert {r.doc_id: r.text for r in private} == {r.doc_id: brute(r.text) for r in clean}
    back = {r.doc_id: r.text for r in pieces.decode(held["pieces"], pieces.model_path()).collect()}
    assert back == {r.doc_id: r.text for r in private} and all(r.lossless in (True, None) and r.n_pieces == len(r["ids"] or []) for r in last)


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "ids", "n_pieces", "lossless"] and out.where("lossless = false").count() == 0 and out.count() > 300


def test_empty_documents(spark, folder, tmp_path):
    nothing = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    assert all(df.count() == 0 for df in staged(spark, folder, str(tmp_path), nothing).values())
