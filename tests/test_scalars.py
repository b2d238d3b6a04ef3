import pytest
from pyspark.sql import functions as F

from confluo.functions import scalars as S


def one(spark, f, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(f(F.col("v")).alias("r")).first()["r"]


CASES = [
    (S.normalize_email, " <a@b.co> ", "a@b.co"), (S.normalize_email, "MAILTO:<A.b@C.io>", "a.b@c.io"), (S.normalize_email, "a@b", None), (S.normalize_email, "a@b.co\n", "a@b.co"),
    (S.normalize_name, '"Weber, Ana"', "Ana Weber"), (S.normalize_name, "JEAN-LUC O'NEIL", "Jean-Luc O'Neil"), (S.normalize_name, "a@b.co", None), (S.normalize_name, "123", None),
    (S.normalize_phone, "+1 (415) 555-2671", "+14155552671"), (S.normalize_phone, "0044 20 7183 8750", "+442071838750"), (S.normalize_phone, "415-555-2671", None), (S.normalize_phone, "tel:+919812345678", "+919812345678"), (S.normalize_phone, "+999123", None),
    (S.normalize_month, "2024/3/15", "2024-03"), (S.normalize_month, "3-2024", "2024-03"), (S.normalize_month, "Sept., 2021", "2021-09"), (S.normalize_month, "2024", None), (S.normalize_month, "13/2024", None),
    (S.normalize_end, " Till Date ", "present"), (S.extract_year, "class of 1999, then 2001", 1999), (S.extract_year, "1843", None),
    (S.normalize_url, "WWW.Example.com/a/?x=1#y", "https://example.com/a"), (S.normalize_url, "http://localhost/a", None), (S.normalize_url, "ftp://a.b/c", None), (S.normalize_url, "https://a.b:8080/", "https://a.b"),
    (S.classify_url, "uk.linkedin.com/in/x", "linkedin"), (S.classify_url, "x.github.io", "portfolio"), (S.github_handle, "https://github.com/A-b/repo", "a-b"), (S.github_handle, "github.com/orgs/x", None),
    (S.fold_company, "Acme, Inc. (Pvt) Ltd", "acme"), (S.parse_years, "about 7.5 years", 8.0), (S.parse_years, "99", None), (S.clean_text, "   ", None), (S.name_key, "Zoë  Ó'Hara", "zoe o hara"), (S.candidate_id, " ADA@analyticalengine.io ", "cand_83ee09b85ff7d2fd"), (S.fnv1a64, "", "cbf29ce484222325"),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES, ids=[f"{f.__name__}-{i}" for i, (f, _, _) in enumerate(CASES)])
def test_scalar(spark, f, value, want):
    assert one(spark, f, value) == want


def test_country_and_skill(spark):
    table = S.country_table(spark)
    got = [one(spark, lambda c: S.normalize_country(c, table), v) for v in ("in", "DEU", "Brazil", "U.K.", "Atlantis", "constructor")]
    assert got == ["IN", "DE", "BR", "GB", None, None]
    skills = [one(spark, S.normalize_skill, v) for v in ("k8s", "React 18", "mentoring.", "  ")]
    assert [s and tuple(s) for s in skills] == [("Kubernetes", True), ("React", True), ("mentoring", False), None]


def test_noisy_or_and_trust(spark):
    df = spark.createDataFrame([([0.88, 0.9, 0.8245, 0.45],), ([],)], "c array<double>")
    assert [r[0] for r in df.select(S.noisy_or(F.col("c"))).collect()] == [0.9988, 0.0]
    assert spark.range(1).select(S.base_confidence(F.lit("github"), F.lit("api_field"))).first()[0] == 0.8245
