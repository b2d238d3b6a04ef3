"""Steps that cost far more than their input's bytes tell keep their cost in proportion to it."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from confluo.operators.fuse import education_groups, experience_groups, profiles, value_groups
from confluo.operators.storage import spread
from confluo.plans import queries
from confluo.sources.adapters import BATCH, EMAIL, claim_batches, emails_in


def test_claims_of_many_small_sources_share_batches():
    n = 5000
    kinds = ["notes", "github", "notes", "csv"] * (n // 4)
    texts = ["Name: Ana\nSkills: Go, Rust", "{", "Email: a@b.co", "Name,Skills\nAna,Go\nBo,Rust"] * (n // 4)
    src = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(kinds), pa.array([f"s{i}" for i in range(n)]), pa.array(texts)], ["source_ord", "type", "name", "content"])
    out = list(claim_batches(iter([src, src])))
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == 2 * n // 4 * 9 and len(out) == -(-len(rows) // BATCH)  # 3, an error, 1 and 4 of each four sources
    assert [(r["source_ord"], r["record_idx"], r["emit_ord"], r["path"], r["v_str"]) for r in rows[:3]] == [(0, 0, 0, "full_name", "Ana"), (0, 0, 1, "skill", "Go"), (0, 0, 2, "skill", "Rust")]
    assert rows[3]["error"] and rows[3]["src_name"] == "s1" and [r["record_idx"] for r in rows[5:9]] == [0, 0, 1, 1]


def test_addresses_are_those_of_the_pattern():
    for t in ["a@b.co", "x a.b@c-d.org,e@f", "a@b@c.de @ @@g@h.io", "é@b.co éa@b.co", "a@b.co@d.ef", "no", "a@b.c1 q%+_-@w.xyz.", "ſ@a.com a@b.KK"]:
        assert list(emails_in(t)) == [m[0] for m in EMAIL.finditer(t)]


def test_a_small_file_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("p_partkey"), *[F.lit("x y").alias(c) for c in ("p_name", "p_brand", "p_type")]).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert spread(spark.range(9), "id").rdd.getNumPartitions() == 12
    assert queries.label_lines(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 4


def test_a_text_is_swept_once_for_all_its_keys(spark, tmp_path):
    spark.createDataFrame([(i, f"mail a{i % 3}@b.co or +44 7400 12345{i % 5}") for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    keys = queries._doc_keys(spark, str(tmp_path))
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and keys.count() == 40
    assert not any("documents" in f for f in queries.profile_contacts(spark, str(tmp_path)).inputFiles())


def test_the_walk_over_entities_agrees_with_the_columns(spark):
    r = random.Random(3)
    pick = lambda *xs: r.choice(xs)
    rows = []
    for i in range(400):
        path = pick("skill", "email", "full_name", "experience", "education")
        exp = (pick("Acme Inc", "acme", None, "Zed"), pick("Dev", "dev", None, None), pick("2020-01", "2019-05", None), pick("present", "2021-01", None), pick("s", None)) if path == "experience" else None
        edu = (pick("Uni", "uni", None, "TU"), pick("MSc", "BA", None), pick("X", None), pick(2001, 1990, None)) if path == "education" else None
        rows.append((r.randrange(9), r.randrange(30), i, f"r{i}", path, None if exp or edu else pick("Go", "GO", "rust", "Éa", "a b"), exp, edu, pick("csv", "notes", "other"), pick("s1", "s2", "s3"), pick("m", "n"), pick(0.3, 0.75, 0.9001, float("nan"))))
    claims = spark.createDataFrame(rows, "cluster long, rec long, emit_ord long, record_id string, path string, value string, exp struct<company:string,title:string,start:string,end:string,summary:string>, edu struct<institution:string,degree:string,field:string,end_year:int>, src_type string, src_id string, method string, confidence double").localCheckpoint()
    p = profiles(claims)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan  # claims move once
    got = {x["cluster"]: x for x in p.collect()}
    for path, shown in (("email", "emails"), ("skill", "skills")):
        for c, x in got.items():
            want = value_groups(claims.where((F.col("cluster") == c) & (F.col("path") == path))).orderBy("rank").collect() if c < 2 else None
            if want is not None:
                assert [v if path == "email" else v["name"] for v in x[shown]] == [w["value"] for w in want] and [x["field_confidence"][f"{shown}[{i}]"] for i in range(len(want))] == [w["confidence"] for w in want]
    for field, groups in (("experience", experience_groups), ("education", education_groups)):
        want = {}
        for w in groups(claims).orderBy("cluster", "rank").collect():
            want.setdefault(w["cluster"], []).append(w)
        assert {c: x[field] for c, x in got.items() if x[field]} == {c: [w["entry"] for w in ws] for c, ws in want.items()}
        assert all(got[c]["field_confidence"][f"{field}[{i}]"] == w["confidence"] for c, ws in want.items() for i, w in enumerate(ws))
