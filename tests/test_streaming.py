import json

from confluo.plans.transform import transform_claims
from confluo.streaming.ingest import ingest, stored


def test_files_that_arrive_later_join_the_same_profile(spark, tmp_path):
    folder, out, check = tmp_path / "in", f"file://{tmp_path}/claims", f"file://{tmp_path}/check"
    folder.mkdir()
    (folder / "a.csv").write_text("Name,Email\nAna Weber,ana@x.io\n")
    ingest(spark, f"file://{folder}", out, check).awaitTermination()
    first = stored(spark, out).count()
    (folder / "b.json").write_text(json.dumps({"name": "Ana Weber", "email": "ana@x.io", "skills": ["k8s"]}))
    (folder / "c.bin").write_text("x")
    ingest(spark, f"file://{folder}", out, check).awaitTermination()
    claims = stored(spark, out)
    assert first == 2 and claims.count() == 5
    (p,) = transform_claims(claims).profiles.collect()
    assert p["emails"] == ["ana@x.io"] and p["skills"][0]["name"] == "Kubernetes"
    (folder / "0.csv").write_text("Name,Email\nBo,bo@x.io\n")
    ingest(spark, f"file://{folder}", out, check).awaitTermination()
    order = {r["src_name"]: r["source_ord"] for r in stored(spark, out).select("src_name", "source_ord").distinct().collect()}
    assert order == {"0.csv": 0, "a.csv": 1, "b.json": 2}  # by base names, whenever they came
    assert transform_claims(stored(spark, out)).profiles.count() == 2
