import json
import random

import pytest
from pyspark.sql import functions as F

from confluo.cli import main
from confluo.operators.graph import components, shared_key_components
from confluo.operators.order import numbered
from confluo.plans.project import ProjectionError, parse_config, parse_path, project, to_records, validate_records
from confluo.plans.transform import CANONICAL, from_memory, transform, validate
from confluo.sources import synthetic
from confluo.sources.adapters import claims_of, parse_csv
from confluo.sources.load import load_sources

CSV = 'Name,E-mail,Mobile Number,Current Company,Title,Location,Skills,LinkedIn\n"Weber, Ana",ana@x.io;ANA@y.io,+1 415 555 2671,Acme Inc.,Engineer,"Berlin, Germany","k8s; Go",linkedin.com/in/ana\nN/A,,12,,,,,\n'
ATS = json.dumps({"candidates": [{"First_Name": "Ana", "last_name": "Weber", "primary_email": "ana@x.io", "years_experience": 7.5, "location": {"city": "Berlin", "country": "DE"}, "tags": ["kubernetes", "Chess"], "work_history": [{"org": "ACME", "role": "Engineer", "from": "Mar 2020", "to": "current"}], "schools": [{"name": "TU", "qualification": "MSc", "graduated": 1843}]}, 5]})
GIT = json.dumps({"user": {"login": "anaw", "name": "Ana Weber", "bio": "builds", "company": "@acme", "location": "Berlin, DE", "blog": "ana.github.io"}, "repos": [{"language": "Go"}, {"fork": True, "language": "Perl"}, {"languages": {"Rust": 1, "go": 2}}]})
NOTE = "Name: Ana Weber\nEmail: ana@y.io\nSkills: Go, Sailing\nGitHub: github.com/anaw\nGreat talk. See www.ana.io/blog and +1 (415) 555-2671. 8 years of work. Currently an Engineer at Acme"
CV = "Ana Weber\nana@x.io | +14155552671\nSKILLS\nLanguages: Go, Rust\nEXPERIENCE\nEngineer at Acme (2020-03 - present)\nEDUCATION\nTU Berlin - MSc in Physics, 2012\n"
ALL = [("csv", "a.csv", CSV), ("ats_json", "b.json", ATS), ("github", "c.json", GIT), ("notes", "d.txt", NOTE), ("resume", "e_resume.txt", CV)]


def test_csv_scan():
    assert parse_csv('﻿a,b\r\n"x ""q"", y","l1\nl2"\rz,\n\n"",') == [["a", "b"], ['x "q", y', "l1\nl2"], ["z", ""], ["", ""]]
    assert parse_csv("") == []
    assert parse_csv("a") == [["a"]]


def test_adapters():
    rows = claims_of("csv", CSV)
    assert [(p, v) for n, p, v, _ in rows if n == 0 and p in ("email", "location.city", "location.country")] == [("email", "ana@x.io"), ("email", "ANA@y.io"), ("location.city", "Berlin"), ("location.country", "Germany")]
    assert [(p, v) for n, p, v, _ in rows if n == 1] == [("phone", "12")]
    assert [v for _, p, v, _ in claims_of("github", GIT) if p == "skill"] == ["Go", "Rust"]
    assert {p for _, p, _, _ in claims_of("notes", NOTE)} == {"full_name", "email", "skill", "links.github", "links.other", "phone", "years_experience", "experience"}
    assert [v for _, p, v, _ in claims_of("resume", CV) if p == "education"] == [{"institution": "TU Berlin", "degree": "MSc", "field": "Physics", "end_year": "2012"}]
    for kind in ("csv", "ats_json", "github", "notes", "resume", "other"):
        for bad in ("", "{", "null", "[1, 2]", "\x00\x01�", "foo,bar\n1,2"):
            assert [c for c in claims_of(kind, bad) if c[1] != "full_name"] == []


@pytest.fixture(scope="module")
def ana(spark):
    return transform(from_memory(spark, ALL))


def test_one_profile_from_five_sources(ana):
    validate(ana.profiles)
    (p,) = ana.profiles.collect()
    assert p["full_name"] == "Ana Weber" and p["emails"] == ["ana@x.io", "ana@y.io"] and p["phones"] == ["+14155552671"]
    assert p["location"]["country"] == "DE" and p["experience"][0]["end"] == "present" and p["experience"][0]["start"] == "2020-03"
    assert len(p["experience"]) == 1  # the bare company of the third source backs the titled role
    assert p["education"][0]["end_year"] == 2012
    assert p["field_confidence"]["full_name"] == 0.9999 or p["field_confidence"]["full_name"] > 0.99
    assert [s["name"] for s in p["skills"]][:1] == ["Go"]
    assert ana.drops.where(F.col("message").contains('phone="12"')).count() == 1


def test_order_of_sources_does_not_matter(spark, ana):
    shuffled = ALL[::-1]
    a, b = (r.profiles.select(*[c for c in CANONICAL if c not in ("experience", "education")]).collect() for r in (ana, transform(from_memory(spark, shuffled))))
    assert a == b


def test_projection(spark, ana):
    config = parse_config({"fields": [{"path": "id", "from": "candidate_id", "type": "string", "required": True}, {"path": "first.skill", "from": "skills[0].name", "type": "string", "normalize": "lower"}, {"path": "all", "from": "skills[].name", "type": "string[]"}, {"path": "gone", "from": "nope[3].x", "type": "any"}], "include_confidence": True, "include_provenance": True, "on_missing": "omit"})
    df = project(ana.profiles, config)
    validate_records(df, config)
    row = df.first()
    assert row["first.skill"] == "go" and row["gone"] is None and {p["field"].split("[")[0] for p in row["provenance"]} == {"skills"}
    record = json.loads(to_records(ana.profiles, config).first()["record"])
    assert "gone" not in record and record["confidence"]["first.skill"] == row["confidence"]["first.skill"] and "id" not in record["confidence"]
    strict = parse_config({"fields": [{"path": "x", "from": "links.portfolio[0]", "type": "any"}], "on_missing": "error"})
    with pytest.raises(Exception, match="Missing value"):
        project(ana.profiles, strict).collect()
    with pytest.raises(ProjectionError, match="expected number"):
        project(ana.profiles, parse_config({"fields": [{"path": "full_name", "type": "number"}]}))


@pytest.mark.parametrize("bad", [None, {}, {"fields": []}, {"fields": [{"path": "a", "type": "x"}]}, {"fields": [{"path": "a", "type": "any", "z": 1}]}, {"fields": [{"path": "a", "type": "any"}], "on_missing": "no"}])
def test_bad_configs(bad):
    with pytest.raises(ProjectionError):
        parse_config(bad)


def test_paths():
    assert parse_path("a[0].b[].c") == [("a", 0), ("b", "[]"), ("c", None)]
    assert parse_path("a..b") is None and parse_path("a[0][1]") is None


def test_weak_matches(spark):
    person = lambda mail: json.dumps({"name": "Jo Lee", "email": mail, "company": "x", "work_history": [{"org": "Acme", "role": "Dev"}]})
    other = json.dumps({"name": "Jo Lee", "email": "c@x.io", "work_history": [{"org": "Globex", "role": "Dev"}]})
    loose = json.dumps({"name": "jo lee", "work_history": [{"org": "Acme Inc", "role": "Dev"}]})
    both = json.dumps({"name": "Jo Lee", "work_history": [{"org": "Acme", "role": "Dev"}, {"org": "Globex", "role": "Dev"}]})

    def count(*docs):
        return transform(from_memory(spark, [("ats_json", f"{i}.json", d) for i, d in enumerate(docs)])).profiles.count()

    assert count(person("a@x.io"), loose) == 1
    assert count(person("a@x.io"), person("b@x.io"), loose) == 3  # ambiguous: stays apart
    assert count(person("a@x.io"), other, both) == 2  # may join one of them, never both


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    want = {x: top(x) for e in edges for x in e if e[0] != e[1]}
    df = spark.createDataFrame(edges, "a long, b long")
    for bound in (0, 1000):
        got = {row.id: row.label for row in components(df, bound).collect()}
        assert {k: got.get(k, k) for k in want} == want
    keys = spark.createDataFrame([(3, "y"), (1, "x"), (2, "x"), (2, "y"), (4, "z"), (4, "z"), (None, "x"), (5, None)], "n long, k string")
    for bound in (0, 1000):
        assert sorted(map(tuple, shared_key_components(keys, "n", "k", bound).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_two_records_make_one_person(spark):
    r = transform(synthetic.sources(spark, 60, 25))
    validate(r.profiles)
    assert r.profiles.count() == 60 and r.diagnostics().count() == 0


def test_load(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.csv": CSV, "sub/c.json": GIT, "b.json": ATS, "my_resume.md": CV, "x.docx": "x", "y.bin": "x", "n.txt": "﻿Name: A", "_under.csv": CSV, "sub/_x/d.txt": "Name: B", ".dot.csv": CSV, "sub/.git/e.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    src, skipped = load_sources(spark, [str(tmp_path), str(tmp_path / "absent.csv")])
    assert [(r.name, r.type) for r in src.orderBy("source_ord").collect()] == [("_under.csv", "csv"), ("a.csv", "csv"), ("b.json", "ats_json"), ("c.json", "github"), ("d.txt", "notes"), ("my_resume.md", "resume"), ("n.txt", "notes")]
    assert src.where("path LIKE '%/sub/_x/d.txt' OR path LIKE '%/_under.csv'").count() == 2 and [r.source_ord for r in src.orderBy("source_ord").collect()] == list(range(7))
    assert {r.name for r in skipped.collect()} == {"x.docx", "y.bin", "absent.csv"}
    assert not src.where(F.col("content").startswith("﻿")).count()


def test_pdf_with_an_extractor(spark, tmp_path):
    (tmp_path / "cv.pdf").write_bytes(b"%PDF " + CV.encode())
    assert {r.reason for r in load_sources(spark, [str(tmp_path)])[1].collect()} == {"no PDF text extractor is configured"}
    src, skipped = load_sources(spark, [str(tmp_path)], F.pandas_udf(lambda s: s.map(lambda b: b[5:].decode()), "string"))
    assert skipped.count() == 0 and transform(src).profiles.first()["full_name"] == "Ana Weber"


def test_sources_that_cannot_be_read_are_reported(spark):
    r = transform(from_memory(spark, [("csv", "a.csv", CSV), ("github", "b.json", "{"), ("github", "c.json", '{"user": {"name": "Ana", "login": "x"}, "repos": [{"language": 5}]}')]))
    assert {x["name"] for x in r.failed.collect()} >= {"b.json"} and r.profiles.count() >= 1


def test_numbers_follow_the_order(spark):
    r = random.Random(2)
    rows = [(f"{r.randrange(10**6)}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "name string, i long").repartition(7)
    got = sorted((x["n"], x["name"], x["i"]) for x in numbered(df, ["name", "i"], "n").collect())
    assert [(a, b) for _, a, b in got] == sorted(rows) and [n for n, _, _ in got] == list(range(5000))


def test_command_line(spark, tmp_path, capsys):
    made = synthetic.write(spark, 5, str(tmp_path / "in"), 3)
    (tmp_path / "in" / "bad.docx").write_text("x")
    (tmp_path / "c.json").write_text(json.dumps({"fields": [{"path": "mail", "from": "emails[0]", "type": "string"}]}))
    assert len(made) == 4 and main(["-i", str(tmp_path / "in"), "-o", str(tmp_path / "out.json")]) == 0
    text = (tmp_path / "out.json").read_text()
    assert len(json.loads(text)) == 5 and text.startswith("[\n  {") and text.endswith("]\n")
    assert capsys.readouterr().err.splitlines() == ["5 profile(s) from 4 source(s)", "skipped bad.docx: DOCX is not supported; export it as PDF or text"]
    assert main(["-i", str(tmp_path / "in"), "-c", str(tmp_path / "c.json"), "--compact", "--quiet"]) == 0
    said = capsys.readouterr()
    assert sorted(x["mail"] for x in json.loads(said.out)) == [f"p{i}@people.example" for i in range(5)] and said.out.count("\n") == 1 and said.err == ""
    assert main(["-i", str(tmp_path / "in"), "-o", str(tmp_path / "lines") + "/", "--quiet"]) == 0
    assert spark.read.text(str(tmp_path / "lines")).count() == 5
    (tmp_path / "c.json").write_text("{}")
    assert main(["-i", str(tmp_path / "in"), "-c", str(tmp_path / "c.json")]) == 1 and "Invalid output config" in capsys.readouterr().err


def test_empty(spark):
    r = transform(from_memory(spark, [("csv", "a.csv", ""), ("github", "b.json", "{")]))
    assert r.profiles.count() == 0 and r.diagnostics().count() == 0
