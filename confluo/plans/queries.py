"""The library's operators on the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import scalars as S
from ..operators.fuse import experience_groups, profiles, value_groups
from ..operators.graph import shared_key_components
from ..operators.resolve import resolve
from ..operators.storage import cut, spread
from ..sources import synthetic
from ..sources.adapters import emails_in, extract, parse_csv, parts, phones_in, split_errors
from . import people
from .transform import CANONICAL, transform, violations

EMAIL, PHONE = dims.EMAIL, dims.PHONE
SWEEPS = {"email": emails_in, "phone": phones_in}
PLAN = "|".join(f"{k}(?:{p})" for k, (_, p) in dims.CALLING.items())
METHOD = {"click": "structured_field", "view": "api_field", "signup": "labeled_field", "purchase": "regex_extraction", "error": "heuristic"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _swept(docs: DataFrame, *kinds: str) -> DataFrame:
    """(doc_id, kind, raw): what the notes adapter sweeps out of each text. One pass, that seeks these kinds only."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [(d, k, v) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) for k in kinds for v in SWEEPS[k](t or "")]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "kind", "raw"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, raw string")


def extract_emails(spark, d):
    return _swept(table(spark, d, "documents"), "email").select("doc_id", "raw", S.normalize_email(F.col("raw")).alias("email"))


def extract_phones(spark, d):
    return _swept(table(spark, d, "documents"), "phone").select("doc_id", "raw", S.normalize_phone(F.col("raw")).alias("phone"))


def norm_urls(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", S.normalize_url(u).alias("url"), S.classify_url(u).alias("kind"), S.github_handle(u).alias("handle"))


def norm_month(spark, d):
    day = F.col("o_orderdate")
    forms = F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "M/yyyy"), F.date_format(day, "MMMM yyyy"), F.date_format(day, "MMM. yyyy"), F.date_format(day, "yyyy"))
    rows = table(spark, d, "orders").select(F.explode(forms).alias("v"))
    return rows.groupBy(S.normalize_month(F.col("v")).alias("month")).agg(F.count("*").alias("n"))


def extract_year(spark, d):
    v = F.concat(F.lit("shipped "), F.date_format("l_shipdate", "dd MM yyyy"), F.lit(" by truck"))
    return table(spark, d, "lineitem").groupBy(S.extract_year(v).alias("year")).agg(F.count("*").alias("n"))


def norm_name(spark, d):
    c = table(spark, d, "customer")
    swapped, loud = F.concat_ws(", ", "c_mktsegment", "c_name"), F.concat(F.lit('"'), F.upper("c_mktsegment"), F.lit(" o'neil-smith"), F.lit('"'))
    return c.select("c_custkey", S.normalize_name(swapped).alias("name"), S.normalize_name(F.upper(loud)).alias("title"), S.name_key(F.col("c_name")).alias("key"))


def fold_company(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.fold_company(F.concat("s_name", F.lit(" Trading Co., Ltd."))).alias("folded"))


def _extracted(spark, rows: DataFrame, kind: str, ordinal: str, content) -> DataFrame:
    """Claims of one source per row. The rows are dealt to all cores: a table in one small file would be one task's."""
    return split_errors(extract(spread(rows, ordinal).select(F.col(ordinal).cast("long").alias("source_ord"), F.lit(kind).alias("type"), F.lit("s").alias("name"), content.alias("content"))))[0]


def parse_props(spark, d):
    """Events of each user as a JSON source: the type is the name, the property its years."""
    e = table(spark, d, "events")
    record = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "yoe": '), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit("}"))
    text = e.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("t"))
    claims = _extracted(spark, text, "ats_json", "user_id", F.col("t"))
    both = claims.groupBy("rec").agg(F.max(F.when(F.col("path") == "full_name", F.col("v_str"))).alias("event_type"), F.max(F.when(F.col("path") == "years_experience", F.col("v_num"))).alias("k"))
    return both.groupBy("event_type").agg(F.sum("k").cast("bigint").alias("total"), F.count("k").alias("n"))


def base_confidence(spark, d):
    method = S.lookup(METHOD, F.col("event_type"))
    e = table(spark, d, "events").select("event_type", *[S.base_confidence(F.lit(s), method).alias(s) for s in dims.SOURCE_TRUST])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *[F.max(s).alias(s) for s in dims.SOURCE_TRUST])


def _as_claims(spark, d):
    """Line items as claims of parts: each supplier says how a part is shipped."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_partkey").alias("cluster"), F.lit("skill").alias("path"), F.concat("l_returnflag", F.lower("l_linestatus")).alias("value"), F.concat(F.lit("notes:"), F.col("l_suppkey").cast("string")).alias("src_id"),
        F.lit("notes").alias("src_type"), F.when(F.col("l_linenumber") > 3, "heuristic").otherwise("regex_extraction").alias("method"), S.round4(F.lit(0.3) + F.col("l_discount")).alias("confidence"),
    )


def noisy_or_agg(spark, d):
    return value_groups(_as_claims(spark, d)).select("cluster", F.lower("value").alias("key"), "confidence", F.col("n").cast("long").alias("n_sources"))


def pick_multi(spark, d):
    return value_groups(_as_claims(spark, d)).select("cluster", F.col("rank").cast("long").alias("rank"), "value")


def pick_single(spark, d):
    return value_groups(_as_claims(spark, d)).where("rank = 0").select("cluster", "value", "confidence")


def pick_display(spark, d):
    forms = F.array("p_type", F.lower("p_type"), F.initcap("p_type"))
    v = table(spark, d, "part").select(F.explode(forms).alias("v"))
    best = F.min(F.struct((-S.upper_count(F.col("v"))).alias("u"), F.col("v").alias("v")))
    return v.groupBy(F.lower("v").alias("key")).agg(best["v"].alias("shown"), F.count("*").alias("n"))


def coalesce_merge(spark, d):
    """Orders as roles of their customer, merged by status and priority: start from the first that has one, end if any is open."""
    o = table(spark, d, "orders")
    role = F.struct(
        F.col("o_orderstatus").alias("company"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_totalprice") > 250_000, F.date_format("o_orderdate", "yyyy-MM")).alias("start"),
        F.when(F.col("o_totalprice") < 50_000, "present").alias("end"), F.lit(None).cast("string").alias("summary"),
    )
    claims = o.select(
        F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("rec"), F.lit(0).cast("long").alias("emit_ord"), F.lit("experience").alias("path"), role.alias("exp"), F.concat(F.lit("csv:"), F.col("o_orderkey").cast("string")).alias("src_id"),
        F.lit("structured_field").alias("method"), F.lit(0.3).alias("confidence"),
    )
    return experience_groups(claims).select(F.col("cluster").alias("o_custkey"), "entry.company", "entry.title", "entry.start", F.col("entry.end").alias("until"), "confidence", F.col("rank").cast("long").alias("rank"))


def _doc_keys(spark, d):
    raw, mail = F.col("raw"), F.col("kind") == "email"
    value = F.when(mail, S.normalize_email(raw)).otherwise(S.normalize_phone(raw))
    swept = _swept(table(spark, d, "documents"), "email", "phone")
    return swept.select("doc_id", F.concat("kind", F.lit(":"), value).alias("key")).where("key IS NOT NULL").distinct()


def strong_key_cc_docs(spark, d):
    return shared_key_components(_doc_keys(spark, d), "doc_id", "key").select(F.col("id").alias("doc_id"), "label")


def strong_key_cc(spark, d):
    """Orders that share a part shipped on the same day, transitively."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat_ws("|", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("key")).distinct()
    return shared_key_components(rows, "l_orderkey", "key").select(F.col("id").alias("l_orderkey"), "label")


def weak_attach(spark, d):
    """Customers as records: the rich have an address, all have a segment as name and a nation as company. The others go to the
    one rich customer of their name and company, if there is exactly one, or else with each other."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("rec"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"), F.lit(" Ltd")).alias("company"), (F.col("c_acctbal") > 8000).alias("rich"))
    nothing = F.lit(None).cast("struct<company:string>")
    each = F.array(
        F.struct(F.lit("full_name").alias("path"), F.col("name").alias("value"), nothing.alias("exp")), F.struct(F.lit("experience").alias("path"), F.lit(None).cast("string").alias("value"), F.struct("company").alias("exp")),
        F.struct(F.when(F.col("rich"), "email").alias("path"), F.concat("rec", F.lit("@rich.example")).alias("value"), nothing.alias("exp")),
    )
    claims = c.select("rec", F.posexplode(each).alias("emit_ord", "s")).select("rec", "emit_ord", "s.path", "s.value", "s.exp").where("path IS NOT NULL")
    return resolve(cut(claims, "records")).select(F.col("rec").alias("c_custkey"), "cluster")


def candidate_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.candidate_id(F.col("c_name")).alias("candidate_id"))


def split_list(spark, d):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [(k, i, x) for k, t in zip(b["p_partkey"].to_pylist(), b["t"].to_pylist(), strict=True) for i, x in enumerate(parts(t, bullets=True))]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["p_partkey", "pos", "item"])

    return table(spark, d, "part").select("p_partkey", F.concat_ws("; ", "p_name", "p_brand", "p_type").alias("t")).mapInArrow(run, "p_partkey long, pos int, item string")


def label_lines(spark, d):
    """Parts as notes with labelled lines."""
    note = F.concat_ws("\r\n", F.concat(F.lit("Name: "), "p_name"), F.concat(F.lit("  skills - "), "p_brand", F.lit(", "), "p_type", F.lit(" • "), F.upper("p_brand")), F.concat(F.lit("BASED IN: "), "p_type", F.lit(", Germany")), F.lit("Other: nothing"))
    claims = _extracted(spark, table(spark, d, "part"), "notes", "p_partkey", note)
    return claims.select(F.col("source_ord").alias("p_partkey"), F.col("emit_ord").alias("pos"), "path", F.col("v_str").alias("value"), "method", "confidence")


def resume_claims(spark, d):
    """Suppliers as résumés: contacts, a name line, and three sections."""
    k, n, t = F.col("s_suppkey"), F.col("s_nationkey"), F.lit
    lines = [
        F.concat(F.expr("char(65 + s_nationkey)"), t("na Mill")), F.concat(t("s"), k.cast("string"), t("@mill.example | +44 7400 "), F.lpad(k.cast("string"), 6, "0")), t(""), t("Skills:"), F.concat(t("Tools: Go, Loom "), n.cast("string")),
        t("Work Experience"), F.concat(t("Engineer at Firm "), n.cast("string"), t(" (Jan 2020 - present)")), F.concat(t("Intern - Mill "), k.cast("string"), t(" (06/2018 - 12/2018)")), t("no dates here"), t("EDUCATION"),
        F.concat(t("Uni "), n.cast("string"), t(" — MSc in Physics, "), (n + 1990).cast("string")),
    ]
    claims = _extracted(spark, table(spark, d, "supplier"), "resume", "s_suppkey", F.concat_ws("\n", *lines))
    return claims.select(
        F.col("source_ord").alias("s_suppkey"), F.col("emit_ord").alias("pos"), "path", F.col("v_str").alias("value"), F.coalesce("v_exp.company", "v_edu.institution").alias("place"), F.coalesce("v_exp.title", "v_edu.degree").alias("title"),
        F.coalesce("v_exp.start", "v_edu.field").alias("about"), F.coalesce("v_exp.end", "v_edu.end_year").alias("until"), "method", "confidence",
    )


def csv_roundtrip(spark, d):
    """Nations rendered as one CSV text with awkward quoting, and parsed back by the CSV scan."""
    cell = F.concat(F.lit('"'), F.regexp_replace("n_name", '"', '""'), F.lit(',""x""\n"'))
    n = table(spark, d, "nation").select(F.concat_ws(",", "n_nationkey", cell, "n_regionkey").alias("r"), F.lit(0).alias("g"))
    text = n.groupBy("g").agg(F.array_join(F.collect_list("r"), "\r\n").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for t in b["text"].to_pylist():
                rows = parse_csv(t)
                yield pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([int(r[2]) for r in rows], pa.int32())], ["n_nationkey", "cell", "n_regionkey"])

    return text.select("text").mapInArrow(run, "n_nationkey int, cell string, n_regionkey int")


def transform_people(spark, d):
    """The whole run over synthetic sources: 500 people, two records each."""
    p = transform(synthetic.sources(spark, 500, 100)).profiles
    return p.select(
        "candidate_id", "full_name", F.array_join("emails", ",").alias("email"), F.array_join("phones", ",").alias("phone"), "location.city", "location.country", "headline", F.col("experience")[0]["company"].alias("company"),
        F.array_join(F.col("skills.name"), ",").alias("skills"),
    )


def flagship(spark, d):
    """Documents as records: contacts swept, normalized, linked by shared keys, fused into profiles."""
    keys = cut(_doc_keys(spark, d), "keys")  # read twice; the texts are swept once
    label = cut(shared_key_components(keys, "doc_id", "key"), "labels")
    value = F.split_part("key", F.lit(":"), F.lit(2))
    claims = keys.join(label, F.col("doc_id") == F.col("id")).select(
        F.col("label").alias("cluster"), F.col("doc_id").alias("rec"), F.concat(F.lit("notes:doc"), F.col("doc_id").cast("string"), F.lit("#0")).alias("record_id"), F.xxhash64("key").alias("emit_ord"),
        F.split_part("key", F.lit(":"), F.lit(1)).alias("path"), value.alias("value"), F.lit(None).cast("struct<company:string,title:string,start:string,end:string,summary:string>").alias("exp"),
        F.lit(None).cast("struct<institution:string,degree:string,field:string,end_year:int>").alias("edu"), F.lit("notes").alias("src_type"), F.concat(F.lit("notes:doc"), F.col("doc_id").cast("string")).alias("src_id"),
        F.lit("regex_extraction").alias("method"), S.base_confidence(F.lit("notes"), F.lit("regex_extraction")).alias("confidence"),
    )
    return profiles(claims).select(*CANONICAL)


def profile_contacts(spark, d):
    """The flagship's contacts and confidences as flat rows."""
    p = flagship(spark, d)
    bad = F.size(F.array_compact(F.array(*[F.when(b, n) for n, b in violations().items()])))
    return p.select("candidate_id", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), "overall_confidence", bad.cast("long").alias("broken"))


QUERIES = {
    f.__name__: f
    for f in [
        extract_emails, extract_phones, norm_urls, norm_month, extract_year, norm_name, fold_company, parse_props, base_confidence, noisy_or_agg, pick_multi, pick_single, pick_display,
        coalesce_merge, strong_key_cc_docs, strong_key_cc, weak_attach, candidate_id, split_list, label_lines, resume_claims, csv_roundtrip, transform_people, profile_contacts,
    ]
}

QUERIES |= people.QUERIES

_R4 = "floor(({}) * 10000.0 + 0.5) / 10000.0"
_MAIL = f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS raw FROM documents"
_TEL = f"SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE}')) AS raw FROM documents"
_DIG = "CASE WHEN starts_with(raw, '00') THEN substr(regexp_replace(raw, '[^0-9]', '', 'g'), 3) ELSE regexp_replace(raw, '[^0-9]', '', 'g') END"
_E164 = f"CASE WHEN regexp_full_match({_DIG}, '{PLAN}') THEN '+' || {_DIG} WHEN regexp_full_match(regexp_replace({_DIG}, '^(4[0-9]|33|61|81|82)0', '\\1'), '{PLAN}') THEN '+' || regexp_replace({_DIG}, '^(4[0-9]|33|61|81|82)0', '\\1') END"
_KEYS = f"""k AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, 'email:' || lower(raw) AS key FROM ({_MAIL}) UNION ALL SELECT doc_id, 'phone:' || ({_E164}) FROM ({_TEL})) WHERE key IS NOT NULL)"""
_CC = "r AS (SELECT DISTINCT {id} AS a, {id} AS b FROM k UNION SELECT r.a, y.{id} FROM r JOIN k x ON r.b = x.{id} JOIN k y ON x.key = y.key)"
_CLAIMS = f"""c AS (SELECT l_partkey AS cluster, l_returnflag || lower(l_linestatus) AS value, l_suppkey AS s, {_R4.format("0.3 + l_discount")} AS conf FROM lineitem),
p AS (SELECT cluster, lower(value) AS key, s, max(conf) AS conf FROM c GROUP BY ALL),
w AS (SELECT cluster, lower(value) AS key, arg_min(value, (-length(regexp_replace(value, '[^A-Z]', '', 'g')), value)) AS value FROM c GROUP BY ALL),
g AS (SELECT cluster, key, value, count(*) AS n, {_R4.format("1.0 - list_reduce(list_prepend(1.0::DOUBLE, list(1.0 - conf ORDER BY 'notes:' || s)), lambda a, b: a * b)")} AS confidence FROM p JOIN w USING (cluster, key) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, n DESC, value) - 1 AS rank FROM g)"""
_CONF = ", ".join(f"{_R4.format(f'{v} * t')} AS {s}" for s, v in dims.SOURCE_TRUST.items())
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2*i-1:2*i])::BIGINT::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_MONTH = "CASE WHEN regexp_matches(v, '^[0-9]{4}$') THEN NULL ELSE strftime(day, '%Y-%m') END"

SQL = {
    "extract_emails": f"SELECT doc_id, raw, lower(raw) AS email FROM ({_MAIL})",
    "extract_phones": f"SELECT doc_id, raw, {_E164} AS phone FROM ({_TEL})",
    "norm_urls": r"""WITH x AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, 'https://' || host || regexp_replace(path, '/$', '') AS url,
  CASE WHEN host = 'linkedin.com' OR ends_with(host, '.linkedin.com') THEN 'linkedin' WHEN host = 'github.com' OR ends_with(host, '.github.com') THEN 'github' WHEN ends_with(host, '.github.io') THEN 'portfolio' ELSE 'other' END AS kind,
  CASE WHEN host = 'github.com' AND regexp_matches(path, '^/[A-Za-z0-9-]{1,39}(/|$)') THEN lower(split_part(path, '/', 2)) END AS handle FROM x""",
    "norm_month": "SELECT month, sum(n)::BIGINT AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, 4 AS n FROM orders UNION ALL SELECT NULL, 1 FROM orders) GROUP BY month",
    "extract_year": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY ALL",
    "norm_name": r"""SELECT c_custkey, c_name || ' ' || c_mktsegment AS name, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' O''Neil-Smith' AS title,
  trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM customer""",
    "fold_company": "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') || 'trading' AS folded FROM supplier",
    "parse_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY event_type",
    "base_confidence": f"WITH m AS (SELECT event_type, count(*) AS n, CASE event_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {dims.METHOD_TRUST[v]}::DOUBLE' for k, v in METHOD.items())} END AS t FROM events GROUP BY event_type) SELECT event_type, n, {_CONF.replace('0.9 * t', '0.9::DOUBLE * t')} FROM m",
    "noisy_or_agg": f"WITH {_CLAIMS} SELECT cluster, key, confidence, n AS n_sources FROM g",
    "pick_multi": f"WITH {_CLAIMS} SELECT cluster, rank, value FROM q",
    "pick_single": f"WITH {_CLAIMS} SELECT cluster, value, confidence FROM q WHERE rank = 0",
    "pick_display": "SELECT lower(p_type) AS key, arg_min(v, (-length(regexp_replace(v, '[^A-Z]', '', 'g')), v)) AS shown, count(*) AS n FROM (SELECT p_type, unnest([p_type, lower(p_type), array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')]) AS v FROM part) GROUP BY lower(p_type)",
    "coalesce_merge": f"""WITH o AS (SELECT *, CASE WHEN o_totalprice > 250000 THEN strftime(o_orderdate, '%Y-%m') END AS s, o_totalprice < 50000 AS open FROM orders),
g AS (SELECT o_custkey, o_orderstatus AS company, o_orderpriority AS title, arg_min(s, o_orderkey) FILTER (WHERE s IS NOT NULL) AS start, CASE WHEN bool_or(open) THEN 'present' END AS until, min(o_orderkey) AS seq,
  {_R4.format("1.0 - list_reduce(list_prepend(1.0::DOUBLE, list(1.0 - 0.3::DOUBLE)), lambda a, b: a * b)")} AS confidence FROM o GROUP BY ALL)
SELECT o_custkey, company, title, start, until, confidence, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(until = 'present', false) DESC, coalesce(start, '0000-00') DESC, company, seq) - 1 AS rank FROM g""",
    "strong_key_cc_docs": f"WITH RECURSIVE {_KEYS}, {_CC.format(id='doc_id')} SELECT a AS doc_id, min(b) AS label FROM r GROUP BY a",
    "strong_key_cc": f"WITH RECURSIVE k AS (SELECT DISTINCT l_orderkey, l_partkey || '|' || strftime(l_shipdate, '%Y-%m-%d') AS key FROM lineitem), {_CC.format(id='l_orderkey')} SELECT a AS l_orderkey, min(b) AS label FROM r GROUP BY a",
    "weak_attach": """WITH c AS (SELECT c_custkey, c_acctbal > 8000 AS rich, c_nationkey AS a, c_mktsegment AS b FROM customer), g AS (SELECT a, b, count(*) FILTER (WHERE rich) AS n, min(c_custkey) AS first, min(c_custkey) FILTER (WHERE NOT rich) AS poor FROM c GROUP BY ALL)
SELECT c_custkey, CASE WHEN n = 1 THEN first WHEN rich THEN c_custkey ELSE poor END AS cluster FROM c JOIN g USING (a, b)""",
    "candidate_id": f"SELECT c_custkey, 'cand_' || lpad(lower(to_hex({_FNV})), 16, '0') AS candidate_id FROM (SELECT c_custkey, hex(encode(lower(trim(c_name)))) AS h FROM customer)",
    "split_list": "SELECT p_partkey, CAST(unnest(range(0, len(x))) AS INTEGER) AS pos, unnest(x) AS item FROM (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || '; ' || p_brand || '; ' || p_type, '[,;\\n|•·]+'), lambda v: trim(v)), lambda v: v <> '') AS x FROM part)",
    "label_lines": f"""SELECT p_partkey, pos, path, value, 'labeled_field' AS method, {_R4.format("0.55::DOUBLE * 0.85::DOUBLE")} AS confidence FROM (SELECT p_partkey, unnest([{{'pos': 0::BIGINT, 'path': 'full_name', 'value': p_name}}, {{'pos': 1, 'path': 'skill', 'value': p_brand}}, {{'pos': 2, 'path': 'skill', 'value': p_type}},
  {{'pos': 3, 'path': 'location.city', 'value': p_type}}, {{'pos': 4, 'path': 'location.country', 'value': 'Germany'}}], recursive := true) FROM part)""",
    "csv_roundtrip": "SELECT n_nationkey, n_name || ',\"x\"' || chr(10) AS cell, n_regionkey FROM nation",
}
_ROW = "SELECT s_suppkey, {0}::BIGINT AS pos, '{1}' AS path, {2} AS value, {3} AS place, {4} AS title, {5} AS about, {6} AS until, '{7}' AS method, " + _R4.format("0.75::DOUBLE * {8}::DOUBLE") + " AS confidence FROM supplier"
_RESUME = [
    ("email", "'s' || s_suppkey || '@mill.example'", "NULL", "NULL", "NULL", "NULL", "regex_extraction"), ("phone", "'+44 7400 ' || lpad(s_suppkey::VARCHAR, 6, '0')", "NULL", "NULL", "NULL", "NULL", "regex_extraction"),
    ("full_name", "chr(65 + s_nationkey) || 'na Mill'", "NULL", "NULL", "NULL", "NULL", "heuristic"), ("skill", "'Go'", "NULL", "NULL", "NULL", "NULL", "labeled_field"), ("skill", "'Loom ' || s_nationkey", "NULL", "NULL", "NULL", "NULL", "labeled_field"),
    ("education", "NULL", "'Uni ' || s_nationkey", "'MSc'", "'Physics'", "(s_nationkey + 1990)::VARCHAR", "regex_extraction"),
    ("experience", "NULL", "'Firm ' || s_nationkey", "'Engineer'", "'Jan 2020'", "'present'", "regex_extraction"), ("experience", "NULL", "'Mill ' || s_suppkey", "'Intern'", "'06/2018'", "'12/2018'", "regex_extraction"),
]
SQL["resume_claims"] = " UNION ALL ".join(_ROW.format(i, *r, dims.METHOD_TRUST[r[-1]]) for i, r in enumerate(_RESUME))
_ID = f"'cand_' || lpad(lower(to_hex({_FNV})), 16, '0')"
SQL["transform_people"] = f"""WITH p AS (SELECT i, hex(encode(email)) AS h, email FROM (SELECT i, 'p' || lower(to_base(i, 36)) || '@people.example' AS email FROM range(500) t(i)))
SELECT {_ID} AS candidate_id, {synthetic.GIVEN}[i % {len(synthetic.GIVEN)} + 1] || ' ' || {synthetic.FAMILY}[i % {len(synthetic.FAMILY)} + 1] AS full_name, email, '+447' || lpad((i + 400000000)::VARCHAR, 9, '0') AS phone,
  {[t for t, _, _ in synthetic.TOWNS]}[i % 4 + 1] AS city, {[c for _, _, c in synthetic.TOWNS]}[i % 4 + 1] AS country, {synthetic.ROLES}[i * 3 % 4 + 1] AS headline, {synthetic.EMPLOYERS}[i % 5 + 1] AS company,
  {synthetic.SHARED}[i % 3 + 1] || CASE i % 3 WHEN 0 THEN ',Go' WHEN 1 THEN ',Kubernetes' ELSE '' END || ['{"','".join([",Machine Learning", ",Docker"])}'][i % 2 + 1] || CASE i % 3 WHEN 2 THEN ',Falconry' ELSE '' END AS skills FROM p"""
SQL["profile_contacts"] = f"""WITH RECURSIVE {_KEYS}, {_CC.format(id="doc_id")}, lab AS (SELECT a AS doc_id, min(b) AS label FROM r GROUP BY a),
g AS (SELECT label, split_part(key, ':', 1) AS path, split_part(key, ':', 2) AS value, count(*) AS n, {_R4.format(f"1.0 - list_reduce(list_prepend(1.0::DOUBLE, list(1.0 - {_R4.format('0.55::DOUBLE * 0.7::DOUBLE')})), lambda a, b: a * b)")} AS conf FROM k JOIN lab USING (doc_id) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY label, path ORDER BY conf DESC, n DESC, value) AS rank FROM g),
p AS (SELECT coalesce(string_agg(value, ',' ORDER BY rank) FILTER (WHERE path = 'email'), '') AS emails, coalesce(string_agg(value, ',' ORDER BY rank) FILTER (WHERE path = 'phone'), '') AS phones, max(conf) FILTER (WHERE path = 'email' AND rank = 1) AS a, max(conf) FILTER (WHERE path = 'phone' AND rank = 1) AS b FROM q GROUP BY label)
SELECT {_ID} AS candidate_id, emails, phones, {_R4.format("(coalesce(3.0 * a, 0.0) + coalesce(2.0 * b, 0.0)) / (if(a IS NULL, 0.0, 3.0) + if(b IS NULL, 0.0, 2.0))")} AS overall_confidence, 0::BIGINT AS broken
FROM (SELECT *, hex(encode(lower(split_part(CASE WHEN emails <> '' THEN emails ELSE phones END, ',', 1)))) AS h FROM p)"""
SQL |= people.SQL
