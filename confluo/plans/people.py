"""The whole run on the driver's customers: each customer is told of by a table, and some by JSON records, profiles of a code
host and notes. Queries look at the fused profiles from several sides; the SQL restates claims, fusion and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..operators.storage import spread
from .project import parse_config, project, to_records, validate_records
from .transform import Result, transform, validate, violations

HEADER = "Name,E-mail,Phone,Current Company,Title,Skill Set,Based In,Years of Experience,GitHub"
PER_FILE = 1000


def _text(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def sources(spark, d) -> DataFrame:
    """Tables and JSON of 1,000 customers each; single profiles and notes for some customers."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    k, n, six = F.col("k"), F.col("n"), F.lpad(F.col("k").cast("string"), 6, "0")
    line = F.concat_ws(
        ",", _text('"%s, %s"', F.col("seg"), F.col("name")), F.concat(_text("C%d@SHOP.EXAMPLE", k), F.when(k % 5 == 0, _text(";d%d@shop.example", k)).otherwise("")),
        F.when(k % 7 == 0, "call me").otherwise(F.concat(F.lit("+44 7400 "), six)), _text('"Firm %d, Inc."', n), F.when(k % 3 == 0, "").otherwise("Engineer"), F.lit('"k8s; Golang; Juggling"'),
        _text('"Town %d, %s"', n, F.when(n % 2 == 0, "Germany").otherwise("Atlantis")), _text("%d yrs", k % 90), F.when(k % 2 == 0, _text("https://github.com/C%d/", k)).otherwise(""),
    )
    account = F.struct(
        F.upper("name").alias("name"), _text("c%d@shop.example", k).alias("primary_email"), F.concat(F.lit("0044 7400-"), six).alias("mobile"), F.array(F.lit("Kubernetes"), F.lit("juggling"), F.lit("React 18")).alias("tags"),
        F.array(F.struct(_text("FIRM %d", n).alias("org"), F.lit("engineer").alias("role"), F.lit("Mar 2020").alias("from"), F.lit("present").alias("to"))).alias("work_history"),
        F.array(F.struct(_text("Uni %d", n).alias("school"), F.lit("MSc").alias("degree"), F.lit("in 2012").alias("graduated"))).alias("education"),
        F.struct(_text("Town %d", n).alias("city"), F.lit("DE").alias("country")).alias("location"),
    )
    user = F.struct(_text("c%d", k).alias("login"), F.col("name"), F.lit("builds things").alias("bio"), _text("Town %d, Germany", n).alias("location"), _text("www.site%d.example/me", k).alias("blog"), _text("@Firm %d", n).alias("company"))
    repos = F.array(F.struct(F.lit("Rust").alias("language"), F.lit(False).alias("fork")), F.struct(F.lit("Go").alias("language"), F.lit(True).alias("fork")))
    told = _text("Name: %s\nEmail: c%d@shop.example\nSkills: Go, Sailing\nLocation: Town %d\nSee https://www.site%d.example/me and https://other%d.example/x\nMet after 12 years of work. Currently an Engineer at Firm %d.", F.col("name"), k, n, k, k, n)
    one = lambda kind, first, name, at, content: F.struct((F.lit(first) + at).cast("long").alias("source_ord"), F.lit(kind).alias("type"), _text(name, at).alias("name"), content.alias("content"))
    held = {
        "lines": F.struct("k", line.alias("v")), "accounts": F.when(k % 2 == 0, F.struct("k", account.alias("v"))),
        "hosts": F.when(k % 10 == 0, one("github", 10_000_000, "github-%d.json", k, F.to_json(F.struct(user.alias("user"), repos.alias("repos"))))), "notes": F.when(k % 25 == 0, one("notes", 20_000_000, "note-%d.txt", k, told)),
    }
    # dealt by file before the texts are made, so that all cores make and read them, however small the table
    rows = spread(c.withColumn("file", F.floor(k / PER_FILE)), "file").select("file", *[v.alias(name) for name, v in held.items()])
    files = rows.groupBy("file").agg(*[F.collect_list(name).alias(name) for name in held])
    ordered = lambda name: F.transform(F.array_sort(name), lambda r: r["v"])
    csv = one("csv", 0, "customers-%d.csv", F.col("file"), F.concat(F.lit(HEADER + "\n"), F.array_join(ordered("lines"), "\n")))
    ats = F.when(F.size("accounts") > 0, one("ats_json", 1_000_000, "accounts-%d.json", F.col("file"), F.to_json(ordered("accounts"))))
    each = F.array_compact(F.concat(F.array(csv, ats), "hosts", "notes"))
    return files.select(F.explode(each).alias("s")).select("s.source_ord", "s.type", "s.name", F.col("s.name").alias("path"), "s.content")


def run(spark, d, config: dict | None = None) -> Result:
    result = transform(sources(spark, d), config)
    validate(result.profiles)
    return result


def people_profiles(spark, d):
    joined = lambda c: F.array_join(c, ",")
    return run(spark, d).profiles.select(
        "candidate_id", "full_name", joined("emails").alias("emails"), joined("phones").alias("phones"), F.col("location.city").alias("city"), F.col("location.country").alias("country"), "headline",
        "years_experience", joined(F.col("skills.name")).alias("skills"), "overall_confidence",
    )


def people_links(spark, d):
    return run(spark, d).profiles.select("candidate_id", "links.github", "links.portfolio", F.array_join("links.other", ",").alias("other"))


def people_confidence(spark, d):
    return run(spark, d).profiles.select("candidate_id", F.explode("field_confidence").alias("field", "confidence"))


def people_provenance(spark, d):
    return run(spark, d).profiles.select("candidate_id", F.explode("provenance").alias("p")).select("candidate_id", "p.field", "p.source", "p.method")


def people_roles(spark, d):
    p = run(spark, d).profiles
    jobs = p.select("candidate_id", F.lit("experience").alias("kind"), F.explode("experience").alias("e")).select("candidate_id", "kind", F.col("e.company").alias("place"), "e.title", "e.start", F.col("e.end").alias("until"))
    schools = p.select("candidate_id", F.lit("education").alias("kind"), F.explode("education").alias("e")).select("candidate_id", "kind", F.col("e.institution").alias("place"), F.col("e.degree").alias("title"), F.lit(None).cast("string").alias("start"), F.col("e.end_year").cast("string").alias("until"))
    return jobs.union(schools)


def people_diagnostics(spark, d):
    return run(spark, d).diagnostics()


FIELDS = [
    {"path": "id", "from": "candidate_id", "type": "string"}, {"path": "mail", "from": "emails[0]", "type": "string", "required": True, "normalize": "upper"}, {"path": "mail.second", "from": "emails[1]", "type": "string"},
    {"path": "tel", "from": "phones[0]", "type": "string", "normalize": "E164"}, {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"}, {"path": "since", "from": "experience[0].start", "type": "string", "normalize": "date"},
    {"path": "where", "from": "location.country", "type": "string", "normalize": "country"}, {"path": "nothing", "from": "no.such", "type": "any"},
]


def project_null(spark, d):
    r = run(spark, d, {"fields": FIELDS, "include_confidence": True, "include_provenance": True})
    validate_records(r.records, r.config)
    return r.records.select(
        "id", "mail", F.col("`mail.second`").alias("second"), "tel", F.array_join("skills", ",").alias("skills"), "since", F.col("`where`").alias("country"), F.col("nothing").cast("string").alias("nothing"), F.col("confidence.tel").alias("tel_confidence"),
        F.array_join(F.transform("confidence.skills", lambda x: F.format_string("%.4f", x)), ",").alias("skill_confidence"), "overall_confidence", F.size("provenance").cast("long").alias("n_provenance"),
    )


def project_omit(spark, d):
    config = {"fields": [FIELDS[0], FIELDS[2], FIELDS[3], FIELDS[7]], "include_confidence": True, "on_missing": "omit"}
    return to_records(run(spark, d).profiles, parse_config(config)).select("record")


def project_error(spark, d):
    """Fields that all customers have; a lacking one raises (tests)."""
    return project(run(spark, d).profiles, parse_config({"fields": [FIELDS[0], FIELDS[1], FIELDS[4]], "on_missing": "error"})).select("id", "mail", F.array_join("skills", ",").alias("skills"))


def provenance_semi(spark, d):
    """Provenance of the configured fields only."""
    r = run(spark, d, {"fields": [FIELDS[0], FIELDS[3], {"path": "jobs", "from": "experience[].company", "type": "string[]"}], "include_provenance": True})
    return r.records.select(F.explode("provenance").alias("p")).groupBy("p.field", "p.method").agg(F.count("*").alias("n"))


def constraint_violations(spark, d):
    """Profile-like rows of customers, one in ten broken in each way."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    bad = lambda i, right, wrong: F.when(k % 10 == i, wrong).otherwise(right)
    month = F.struct(bad(6, F.lit("2020-12"), F.lit("2020-13")).alias("start"), F.lit("present").alias("end"))
    rows = c.select(
        "k", F.array(bad(0, F.lit("a@b.co"), F.lit("a@b"))).alias("emails"), F.array(bad(1, F.lit("+4915112345678"), F.lit("015112345678"))).alias("phones"), F.struct(bad(2, F.lit("DE"), F.lit("de")).alias("country")).alias("location"),
        bad(3, F.lit(7.0), F.lit(81.0)).alias("years_experience"), bad(4, F.lit(0.5), F.lit(1.5)).alias("overall_confidence"), F.array(F.struct(bad(5, F.lit("Go"), F.lit("")).alias("name"), F.lit(0.9).alias("confidence"))).alias("skills"),
        F.array(month).alias("experience"), F.array(F.struct(bad(7, F.lit(2001), F.lit(1843)).alias("end_year"))).alias("education"),
    )
    return rows.select("k", F.explode(F.array_compact(F.array(*[F.when(b, name) for name, b in violations().items()]))).alias("broken"))


QUERIES = {f.__name__: f for f in [people_profiles, people_links, people_confidence, people_provenance, people_roles, people_diagnostics, project_null, project_omit, project_error, provenance_semi, constraint_violations]}

R4 = "floor(({}) * 10000.0 + 0.5) / 10000.0"
_S = {s: {m: f"({R4.format(f'{v}::DOUBLE * {t}::DOUBLE')})" for m, t in dims.METHOD_TRUST.items()} for s, v in dims.SOURCE_TRUST.items()}
_SRC = {"csv": "'csv:customers-' || f || '.csv'", "ats_json": "'ats_json:accounts-' || f || '.json'", "github": "'github:github-' || k || '.json'", "notes": "'notes:note-' || k || '.txt'"}
_OF = {"csv": "true", "ats_json": "k % 2 = 0", "github": "k % 10 = 0", "notes": "k % 25 = 0"}
_VALUES = [  # path, value, type, method, condition, foreign skill
    ("full_name", "name || ' ' || seg", "csv", "structured_field", "true", 0), ("full_name", "name", "ats_json", "structured_field", "true", 0), ("full_name", "name", "github", "api_field", "true", 0), ("full_name", "name", "notes", "labeled_field", "true", 0),
    ("emails", "'c' || k || '@shop.example'", "csv", "structured_field", "true", 0), ("emails", "'d' || k || '@shop.example'", "csv", "structured_field", "k % 5 = 0", 0), ("emails", "'c' || k || '@shop.example'", "ats_json", "structured_field", "true", 0), ("emails", "'c' || k || '@shop.example'", "notes", "labeled_field", "true", 0),
    ("phones", "'+447400' || six", "csv", "structured_field", "k % 7 <> 0", 0), ("phones", "'+447400' || six", "ats_json", "structured_field", "true", 0),
    ("location.city", "'Town ' || n", "csv", "structured_field", "true", 0), ("location.city", "'Town ' || n", "ats_json", "structured_field", "true", 0), ("location.city", "'Town ' || n", "github", "api_field", "true", 0), ("location.city", "'Town ' || n", "notes", "labeled_field", "true", 0),
    ("location.country", "'DE'", "csv", "structured_field", "n % 2 = 0", 0), ("location.country", "'DE'", "ats_json", "structured_field", "true", 0), ("location.country", "'DE'", "github", "api_field", "true", 0),
    ("headline", "'builds things'", "github", "api_field", "true", 0), ("years_experience", "(k % 90)::VARCHAR", "csv", "structured_field", "k % 90 <= 80", 0), ("years_experience", "'12'", "notes", "regex_extraction", "true", 0),
    ("links.github", "'https://github.com/C' || k", "csv", "structured_field", "k % 2 = 0", 0), ("links.github", "'https://github.com/c' || k", "github", "api_field", "true", 0), ("links.portfolio", "'https://site' || k || '.example/me'", "github", "api_field", "true", 0),
    ("links.other", "'https://site' || k || '.example/me'", "notes", "regex_extraction", "true", 0), ("links.other", "'https://other' || k || '.example/x'", "notes", "regex_extraction", "true", 0),
    ("skills", "'Kubernetes'", "csv", "structured_field", "true", 0), ("skills", "'Go'", "csv", "structured_field", "true", 0), ("skills", "'Juggling'", "csv", "structured_field", "true", 1),
    ("skills", "'Kubernetes'", "ats_json", "structured_field", "true", 0), ("skills", "'juggling'", "ats_json", "structured_field", "true", 1), ("skills", "'React'", "ats_json", "structured_field", "true", 0),
    ("skills", "'Rust'", "github", "api_field", "true", 0), ("skills", "'Go'", "notes", "labeled_field", "true", 0), ("skills", "'Sailing'", "notes", "labeled_field", "true", 1),
    ("experience", "''", "csv", "structured_field", "true", 0), ("experience", "''", "ats_json", "structured_field", "true", 0), ("experience", "''", "github", "api_field", "true", 0), ("experience", "''", "notes", "heuristic", "true", 0), ("education", "''", "ats_json", "structured_field", "true", 0),
]
_CLAIMS = " UNION ALL ".join(
    f"SELECT k, '{p}' AS path, {v} AS value, {_SRC[t]} AS src, {dims.SOURCE_TRUST[t]} AS trust, '{m}' AS method, {R4.format(f'{_S[t][m]} * 0.9::DOUBLE') if foreign else _S[t][m]} AS conf FROM c WHERE {_OF[t]} AND {where}" for p, v, t, m, where, foreign in _VALUES
)
_SINGLE = "path IN ('full_name', 'headline', 'years_experience', 'location.city', 'location.region', 'location.country', 'links.github', 'links.portfolio')"
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2*i-1:2*i])::BIGINT::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
BASE = f"""c AS (SELECT c_custkey AS k, c_nationkey AS n, c_name AS name, c_mktsegment AS seg, c_custkey // {PER_FILE} AS f, lpad(c_custkey::VARCHAR, 6, '0') AS six FROM customer),
ids AS (SELECT k, 'cand_' || lpad(lower(to_hex({_FNV})), 16, '0') AS candidate_id FROM (SELECT k, hex(encode('c' || k || '@shop.example')) AS h FROM c)),
claims AS ({_CLAIMS}),
best AS (SELECT k, path, CASE path WHEN 'skills' THEN lower(value) ELSE value END AS key, src, max(conf) AS conf, max(trust) AS trust FROM claims GROUP BY ALL),
shown AS (SELECT k, path, CASE path WHEN 'skills' THEN lower(value) ELSE value END AS key, arg_min(value, (-length(regexp_replace(value, '[^A-Z]', '', 'g')), value)) AS value FROM claims GROUP BY ALL),
grouped AS (SELECT k, path, key, value, count(*) AS n, max(trust) AS trust, {R4.format("1.0 - list_reduce(list_prepend(1.0::DOUBLE, list(1.0 - conf ORDER BY src)), lambda a, b: a * b)")} AS conf FROM best JOIN shown USING (k, path, key) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, path ORDER BY conf DESC, n DESC, trust DESC, value) - 1 AS rank FROM grouped WHERE NOT (path = 'links.other' AND k % 50 = 0 AND starts_with(value, 'https://site'))),
held AS (SELECT *, CASE WHEN {_SINGLE} THEN path ELSE path || '[' || rank || ']' END AS field FROM ranked WHERE NOT ({_SINGLE}) OR rank = 0),
arrays AS (SELECT k, string_agg(value, ',' ORDER BY rank) FILTER (WHERE path = 'emails') AS emails, coalesce(string_agg(value, ',' ORDER BY rank) FILTER (WHERE path = 'phones'), '') AS phones, string_agg(value, ',' ORDER BY rank) FILTER (WHERE path = 'skills') AS skills,
  coalesce(string_agg(value, ',' ORDER BY rank) FILTER (WHERE path = 'links.other'), '') AS other, max(value) FILTER (WHERE field = 'full_name') AS full_name, max(value) FILTER (WHERE field = 'location.city') AS city, max(value) FILTER (WHERE field = 'location.country') AS country,
  max(value) FILTER (WHERE field = 'headline') AS headline, max(value) FILTER (WHERE field = 'years_experience')::DOUBLE AS years, max(value) FILTER (WHERE field = 'links.github') AS github, max(value) FILTER (WHERE field = 'links.portfolio') AS portfolio,
  max(conf) FILTER (WHERE field = 'full_name') AS c_name, max(conf) FILTER (WHERE field = 'emails[0]') AS c_mail, max(conf) FILTER (WHERE field = 'phones[0]') AS c_tel, max(conf) FILTER (WHERE field = 'location.country') AS c_country, max(conf) FILTER (WHERE field = 'headline') AS c_head,
  list(conf ORDER BY rank) FILTER (WHERE path = 'skills') AS c_skills, max(conf) FILTER (WHERE path = 'experience') AS c_exp, max(conf) FILTER (WHERE path = 'education') AS c_edu, max(conf) FILTER (WHERE starts_with(path, 'links.')) AS c_links FROM held GROUP BY k),
scored AS (SELECT *, {R4.format("list_reduce(list_prepend(0.0::DOUBLE, c_skills), lambda a, b: a + b) / len(c_skills)")} AS c_skill FROM arrays),
people AS (SELECT *, {R4.format("(0.0 + 3.0 * c_name + 3.0 * c_mail + coalesce(2.0 * c_tel, 0.0) + coalesce(c_country, 0.0) + coalesce(c_head, 0.0) + 2.0 * c_skill + 2.0 * c_exp + coalesce(c_edu, 0.0) + coalesce(c_links, 0.0)) / (10.0 + if(c_tel IS NULL, 0, 2) + if(c_country IS NULL, 0, 1) + if(c_head IS NULL, 0, 1) + if(c_edu IS NULL, 0, 1) + if(c_links IS NULL, 0, 1))")} AS overall FROM scored JOIN ids USING (k)),
jobs AS (SELECT k, n, CASE WHEN k % 3 <> 0 THEN 'Firm ' || n || ', Inc.' WHEN k % 2 = 0 THEN 'FIRM ' || n WHEN k % 25 = 0 THEN 'Firm ' || n ELSE 'Firm ' || n || ', Inc.' END AS company,
  CASE WHEN k % 3 <> 0 THEN 'Engineer' WHEN k % 2 = 0 THEN 'engineer' WHEN k % 25 = 0 THEN 'Engineer' END AS title, CASE WHEN k % 2 = 0 THEN '2020-03' END AS start FROM c),
told AS (SELECT DISTINCT k, field, src, method FROM held JOIN claims USING (k, path) WHERE CASE held.path WHEN 'skills' THEN lower(claims.value) ELSE claims.value END = held.key)"""
_TEL = "CASE WHEN phones <> '' THEN phones END"
SQL = {
    "people_profiles": f"WITH {BASE} SELECT candidate_id, full_name, emails, phones, city, country, headline, years AS years_experience, skills, overall AS overall_confidence FROM people",
    "people_links": f"WITH {BASE} SELECT candidate_id, github, portfolio, other FROM people",
    "people_confidence": f"WITH {BASE} SELECT candidate_id, field, conf AS confidence FROM held JOIN ids USING (k)",
    "people_provenance": f"WITH {BASE} SELECT candidate_id, field, src AS source, method FROM told JOIN ids USING (k)",
    "people_roles": f"WITH {BASE} SELECT candidate_id, 'experience' AS kind, company AS place, title, start, 'present' AS until FROM jobs JOIN ids USING (k) UNION ALL SELECT candidate_id, 'education', 'Uni ' || n, 'MSc', NULL, '2012' FROM jobs JOIN ids USING (k) WHERE k % 2 = 0",
    "people_diagnostics": f"""WITH {BASE} SELECT DISTINCT message FROM (SELECT 'dropped phone="call me" from ' || {_SRC["csv"]} || ' (not a valid E.164 phone)' AS message FROM c WHERE k % 7 = 0
  UNION ALL SELECT 'dropped years_experience="' || k % 90 || ' yrs" from ' || {_SRC["csv"]} || ' (not a plausible year count)' FROM c WHERE k % 90 > 80 UNION ALL SELECT 'dropped location.country="Atlantis" from ' || {_SRC["csv"]} || ' (unrecognized country)' FROM c WHERE n % 2 = 1)""",
    "project_null": f"""WITH {BASE}, used AS (SELECT k, count(*) AS n FROM told WHERE field IN ('emails[0]', 'emails[1]', 'phones[0]', 'location.country') OR starts_with(field, 'skills[') OR (field = 'experience[0]' AND k % 2 = 0) GROUP BY k)
SELECT candidate_id AS id, upper(split_part(emails, ',', 1)) AS mail, CASE WHEN contains(emails, ',') THEN split_part(emails, ',', 2) END AS second, {_TEL} AS tel, skills, start AS since, country, NULL::VARCHAR AS nothing, c_tel AS tel_confidence,
  array_to_string(list_transform(c_skills, lambda x: printf('%.4f', x)), ',') AS skill_confidence, overall AS overall_confidence, used.n AS n_provenance FROM people JOIN jobs USING (k) JOIN used USING (k)""",
    "project_omit": f"""WITH {BASE}, m AS (SELECT k, max(conf) FILTER (WHERE field = 'emails[1]') AS c_second FROM held GROUP BY k)
SELECT '{{"id":"' || candidate_id || '"' || CASE WHEN contains(emails, ',') THEN ',"mail.second":"' || split_part(emails, ',', 2) || '"' ELSE '' END || CASE WHEN phones <> '' THEN ',"tel":"' || phones || '"' ELSE '' END || ',"confidence":{{'
  || concat_ws(',', CASE WHEN c_second IS NOT NULL THEN '"mail.second":' || c_second END, CASE WHEN c_tel IS NOT NULL THEN '"tel":' || c_tel END) || '}},"overall_confidence":' || overall || '}}' AS record FROM people JOIN m USING (k)""",
    "project_error": f"WITH {BASE} SELECT candidate_id AS id, upper(split_part(emails, ',', 1)) AS mail, skills FROM people",
    "provenance_semi": f"WITH {BASE} SELECT CASE WHEN field = 'phones[0]' THEN field ELSE 'experience[0]' END AS field, method, count(*) AS n FROM told WHERE field IN ('phones[0]', 'experience[0]') GROUP BY ALL",
    "constraint_violations": "SELECT c_custkey AS k, ['emails', 'phones', 'location.country', 'years_experience', 'overall_confidence', 'skills', 'experience', 'education'][c_custkey % 10 + 1] AS broken FROM customer WHERE c_custkey % 10 < 8",
}
