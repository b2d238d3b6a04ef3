"""Adapters: a source -> atomic claims (record, path, value, method). One Arrow pass over the sources.

Row order matters to the fusion step, so every claim carries ``seq``: source, record and position together.
An adapter that fails yields what it had, and a row with ``error``; it never ends the run.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.scalars import base_confidence

CLAIMS = (
    "source_ord long, record_idx long, emit_ord long, path string, v_str string, v_num double, "
    "v_exp struct<company:string,title:string,start:string,end:string,summary:string>, "
    "v_edu struct<institution:string,degree:string,field:string,end_year:string>, src_type string, src_name string, method string, raw string, error string"
)
Claim = tuple[int, str, object, str]  # record, path, value, method

EMAIL, WEB, PHONE = re.compile(dims.EMAIL, re.I | re.A), re.compile(dims.WEB, re.I), re.compile(dims.PHONE)
YEARS, ROLE_AT, LABELLED = re.compile(dims.YEARS_OF, re.I), re.compile(dims.ROLE_AT), re.compile(dims.LABELLED)
DEGREE, RANGE, YEAR = re.compile(dims.DEGREE, re.I | re.A), re.compile(dims.RANGE, re.I), re.compile(dims.YEAR, re.A)
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")  # of an address, before the @
SPACE = " \t\n\r\v\f\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(s: str) -> str:
    return s.strip(SPACE)


def blank(v: object) -> bool:
    return v is None or (isinstance(v, str) and strip(v).lower() in dims.BLANKS)


def parts(s: str, bullets: bool = False) -> list[str]:
    return [x for x in map(strip, re.split("[,;\n|•·]+" if bullets else "[,;\n|]+", s)) if x]


def number_text(v: float) -> str:
    return str(int(v)) if float(v).is_integer() and abs(v) < 1e21 else repr(float(v))


def parse_csv(text: str) -> list[list[str]]:
    """RFC 4180 rows; quotes may open anywhere, any line end counts, rows of one empty cell are left out."""
    rows, row, cell, quoted, dirty = [], [], [], False, False
    for m in re.finditer(r'""|"|,|\r\n|\r|\n|[^",\r\n]+', text.removeprefix("\ufeff")):
        t = m[0]
        if quoted:
            quoted = t != '"'
            cell.append('"' if t == '""' else t if quoted else "")
        elif t == ",":
            row.append("".join(cell))
            cell, dirty = [], True
        elif t in ("\r\n", "\r", "\n"):
            rows.append([*row, "".join(cell)])
            row, cell, dirty = [], [], False
        elif t in ('"', '""'):
            quoted, dirty = t == '"', True
        else:
            cell.append(t)
            dirty = True
    if dirty or row or cell:
        rows.append([*row, "".join(cell)])
    return [r for r in rows if r != [""]]


def place(value: str) -> list[tuple[str, str]]:
    """City, or city and country, from one text."""
    p = parts(value)
    return [("location.city", p[0]), *([("location.country", p[-1])] if len(p) > 1 else [])] if p else []


def role(company=None, title=None, start=None, end=None, summary=None) -> dict:
    return {"company": company, "title": title, "start": start, "end": end, "summary": summary}


def from_csv(text: str) -> Iterator[Claim]:
    rows = parse_csv(text)
    by_name = {s: slot for slot, names in reversed(dims.CSV_HEADERS.items()) for s in names}
    slots = {i: by_name[k] for i, h in enumerate(rows[0] if rows else []) if (k := re.sub("[^a-z0-9]+", " ", h.lower()).strip()) in by_name}
    for n, row in enumerate(rows[1:] if slots else []):
        cell = {slot: strip(row[i]) for i, slot in slots.items() if i < len(row) and not blank(row[i])}
        made: list[tuple[str, object]] = [("full_name", cell["full_name"])] if "full_name" in cell else []
        made += [(slot, x) for slot in ("email", "phone") for x in parts(cell.get(slot, ""))]
        plain = ["headline", "years_experience", "links.linkedin", "links.github", "links.portfolio", "location.city", "location.region", "location.country"]
        made += [(path, cell[slot]) for path in plain if (slot := path.split(".")[-1]) in cell]
        made += [("skill", x) for x in parts(cell.get("skills", ""), bullets=True)]
        if not {"city", "country"} & cell.keys():
            made += place(cell.get("location", ""))
        if {"company", "title"} & cell.keys():
            made.append(("experience", role(cell.get("company"), cell.get("title"), end="present")))
        for path, v in made:
            yield n, path, v, "structured_field"


class Tolerant:
    """A JSON object read by lists of possible keys: exact spelling first, then without regard to case."""

    def __init__(self, obj: dict):
        self.obj, self.low = obj, {}
        for k, v in obj.items():
            self.low.setdefault(k.lower(), v)

    def get(self, key: str) -> object:
        return self.obj[key] if key in self.obj else self.low.get(key.lower())

    def first(self, keys: list[str]) -> object:
        return next((v for k in keys if (v := self.get(k)) is not None), None)

    def text(self, keys: list[str]) -> str | None:
        v = self.first(keys)
        if isinstance(v, str):
            return None if blank(v) else strip(v)
        return number_text(v) if isinstance(v, int | float) and not isinstance(v, bool) else None

    def all(self, keys: list[str]) -> Iterator[str]:
        for k in keys:
            v = self.get(k)
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, str) and not blank(x):
                    yield strip(x)
                elif isinstance(x, int | float) and not isinstance(x, bool):
                    yield number_text(x)


def ats_records(doc: object) -> list:
    if isinstance(doc, list):
        return doc
    if not isinstance(doc, dict):
        return []
    t = Tolerant(doc)
    many = next((v for k in dims.ATS_KEYS["many"] if isinstance(v := t.get(k), list)), None)
    one = next((v for k in dims.ATS_KEYS["one"] if isinstance(v := t.get(k), dict)), doc)
    return [one] if many is None else many


def listed(v: object) -> list[Tolerant]:
    return [Tolerant(x) for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]


def from_ats(text: str) -> Iterator[Claim]:
    keys = dims.ATS_KEYS
    for n, rec in enumerate(ats_records(json.loads(text.removeprefix("\ufeff")))):
        if not isinstance(rec, dict):
            continue
        r = Tolerant(rec)
        name = r.text(keys["full_name"]) or " ".join(filter(None, (r.text(keys["first"]), r.text(keys["last"]))))
        made: list[tuple[str, object]] = [("full_name", name)]
        made += [("email", v) for v in r.all(keys["email"])] + [("phone", v) for v in r.all(keys["phone"])]
        years = r.first(keys["years"])
        made += [("headline", r.text(keys["headline"])), ("years_experience", None if blank(years) else years)]
        where = r.first(keys["location"])
        w, city, country = (Tolerant(where), "city", "country") if isinstance(where, dict) else (r, "flat_city", "flat_country")
        made += [("location.city", w.text(keys[city])), ("location.region", w.text(keys["region"])), ("location.country", w.text(keys[country]))]
        links = r.first(keys["links"])
        at = Tolerant(links) if isinstance(links, dict) else r
        made += [(f"links.{k}", at.text(keys[k])) for k in ("linkedin", "github", "portfolio")]
        made += [("skill", v) for v in r.all(keys["skills"])]
        for item in listed(r.first(keys["history"])):
            e = {k: item.text(names) for k, names in dims.ATS_EXPERIENCE.items()}
            made.append(("experience", e if e["company"] or e["title"] else None))
        for item in listed(r.first(keys["schools"])):
            e = {k: item.text(names) for k, names in dims.ATS_EDUCATION.items() if k != "end_year"}
            y = item.first(dims.ATS_EDUCATION["end_year"])
            whole = isinstance(y, int | float) and not isinstance(y, bool) and float(y).is_integer()
            found = YEAR.search(y) if isinstance(y, str) else None
            e["end_year"] = str(int(y)) if whole else found[1] if found else None
            made.append(("education", e if e["institution"] or e["degree"] else None))
        for path, v in made:
            if v is not None and v != "":
                yield n, path, v, "structured_field"


def from_github(text: str) -> Iterator[Claim]:
    doc = json.loads(text.removeprefix("\ufeff"))
    if not isinstance(doc, dict):
        return
    user, repos = (doc.get("user"), doc.get("repos")) if {"user", "repos"} & doc.keys() else (doc, [])
    if not user:
        return
    said = lambda k: user.get(k) if user.get(k) and not blank(user.get(k)) else None
    profile = user.get("html_url") if user.get("html_url") is not None else f"https://github.com/{user['login']}" if user.get("login") else None
    made = [("full_name", said("name")), ("headline", said("bio")), ("links.github", profile), ("links.portfolio", said("blog"))]
    made.append(("links.other", f"https://twitter.com/{said('twitter_username')}" if said("twitter_username") else None))
    spots = [x for x in map(strip, (said("location") or "").split(",")) if x]
    made += [("location.city", spots[0]), ("location.country", spots[-1] if len(spots) > 1 else None)] if spots else []
    if said("company"):
        made.append(("experience", role(strip(said("company").removeprefix("@")), end="present")))
    languages: dict[str, str] = {}
    for repo in repos if isinstance(repos, list) else []:
        if not repo.get("fork"):
            by_repo = repo["languages"] if isinstance(repo.get("languages"), dict) else [repo.get("language")]
            for x in by_repo:
                if not blank(x):
                    languages.setdefault(x.lower(), x)
    for path, v in [*made, *(("skill", x) for x in languages.values())]:
        if v:
            yield 0, path, v, "api_field"


def emails_in(text: str) -> Iterator[str]:
    """All matches of ``EMAIL``, sought from each @: a search of the pattern would try the rest of a word at each of its letters."""
    start, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > start and text[first - 1] in LOCAL:
            first -= 1
        m = EMAIL.match(text, first) if first < at else None
        if m:
            yield m[0]
            start = m.end()
        at = text.find("@", max(at + 1, start))


def phones_in(text: str) -> list[str]:
    return PHONE.findall(text) if "+" in text or "00" in text else []


def swept(text: str) -> Iterator[tuple[str, str]]:
    """Contacts found anywhere; a link's path is decided later from its host."""
    yield from (("email", v) for v in emails_in(text))
    if "." in text or "/" in text:
        yield from (("links.?", m[0]) for m in WEB.finditer(text))
    yield from (("phone", v) for v in phones_in(text))


def link_path(url: str) -> str:
    """Slot of a link by its host, as far as text alone tells; agrees with ``scalars.classify_url``."""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?", "", url, flags=re.I)
    host = re.split(r"[/?#:]", host)[0].lower().removeprefix("www.")
    for site, kind in (("linkedin.com", "linkedin"), ("github.com", "github")):
        if host == site or host.endswith("." + site):
            return f"links.{kind}"
    return "links.portfolio" if host.endswith(".github.io") else "links.other" if "." in host else ""


def once() -> Callable[[str, object], bool]:
    """Whether a (path, value) comes for the first time."""
    seen: set = set()

    def new(path: str, v: object) -> bool:
        key = (path, strip(v).lower() if isinstance(v, str) else json.dumps(v))
        return not (key in seen or (isinstance(v, str) and blank(v)) or seen.add(key))

    return new


def from_notes(text: str) -> Iterator[Claim]:
    new = once()
    made: list[tuple[str, str, str]] = []
    for line in re.split("\r?\n", text):
        m = LABELLED.match(line)
        path = dims.NOTE_LABELS.get(strip(m[1].lower())) if m else None
        if path:
            v = strip(m[2])
            found = place(v) if path == "location.city" else [(path, x) for x in (parts(v, path == "skill") if path in ("skill", "email", "phone") else [v])]
            made += [(p, x, "labeled_field") for p, x in found]
    sweep = sorted(swept(text), key=lambda x: ["email", "links.?", "phone"].index(x[0]))
    made += [(link_path(v) if p == "links.?" else p, v, "regex_extraction") for p, v in sweep]
    if m := YEARS.search(text):
        made.append(("years_experience", m[1], "regex_extraction"))
    for path, v, method in made:
        if path and new(path, v):
            yield 0, path, strip(v), method
    if "at" in text and (m := ROLE_AT.search(text)):
        yield 0, "experience", role(re.sub("[.,]$", "", strip(m[2])), strip(re.sub(r"(?i)^currently\s+", "", m[1])), end="present"), "heuristic"


def sections(lines: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    now = None
    for line in lines:
        head = dims.SECTIONS.get(strip(re.sub(r"[:\s]+\Z", "", line.lower())))
        if head and len(line) <= 40:
            now = head
            out.setdefault(now, [])
        elif now and line:
            out[now].append(line)
    return out


def without_dates(s: str) -> str | None:
    return strip(re.sub("[()]", "", RANGE.sub("", s, count=1))) or None


def from_resume(text: str) -> Iterator[Claim]:
    new = once()
    found: list[tuple[str, object, str]] = []
    order = ["email", "phone", "links.?"]
    for p, v in sorted(swept(text), key=lambda x: order.index(x[0])):
        found.append((link_path(v) if p == "links.?" else p, v, "regex_extraction"))
    lines = [strip(x) for x in re.split("\r?\n", text)]
    head = next((x for x in lines if x), "")
    if 1 <= len(head.split()) <= 4 and re.fullmatch(dims.PERSON_LINE, head):
        found.append(("full_name", head, "heuristic"))
    held = sections(lines)
    for line in held.get("skills", []):
        found += [("skill", x, "labeled_field") for x in parts(re.sub(dims.SKILL_GROUP, "", line), bullets=True)]
    for line in held.get("education", []):
        degree, years, field = DEGREE.search(line), YEAR.findall(line), re.search(dims.FIELD_OF_STUDY, line, re.I)
        if degree or years:
            school = strip(re.sub(dims.STUDIES, "", DEGREE.sub("", re.split("[,–—-]", line)[0], count=1), count=1, flags=re.I))
            entry = {"institution": school if len(school) > 1 else None, "degree": degree and degree[0], "field": field and strip(field[1]), "end_year": years[-1] if years else None}
            found.append(("education", entry, "regex_extraction"))
    for line in held.get("experience", []):
        dates, at = RANGE.search(line), re.match(dims.TITLE_AT_COMPANY, line)
        if dates or at:
            both = (without_dates(at[2]), without_dates(at[1])) if at and at[1] and at[2] else (None, None)
            found.append(("experience", role(*both, dates and dates[1], dates and dates[2]), "regex_extraction"))
    for path, v, method in found:
        if path and new(path, v):
            yield 0, path, v, method


ADAPTERS: dict[str, Callable[[str], Iterator[Claim]]] = {"csv": from_csv, "ats_json": from_ats, "github": from_github, "notes": from_notes, "linkedin": from_notes, "resume": from_resume}


def read(kind: str, content: str) -> tuple[list[Claim], str | None]:
    """Claims of a source, and what stopped its adapter."""
    out: list[Claim] = []
    try:
        out.extend(ADAPTERS[kind](content) if kind in ADAPTERS else [])
    except Exception as e:  # noqa: BLE001 - a source that can't be read adds nothing more and never ends the run
        return out, f"{type(e).__name__}: {e}"
    return out, None


def claims_of(kind: str, content: str) -> list[Claim]:
    return read(kind, content)[0]


BATCH = 10_000  # claims of an Arrow batch, over any number of sources: a batch costs far more than a claim
ARROW = pa.schema([
    ("source_ord", pa.int64()), ("record_idx", pa.int64()), ("emit_ord", pa.int64()), ("path", pa.string()), ("v_str", pa.string()), ("v_num", pa.float64()),
    ("v_exp", pa.struct([(k, pa.string()) for k in ("company", "title", "start", "end", "summary")])),
    ("v_edu", pa.struct([(k, pa.string()) for k in ("institution", "degree", "field", "end_year")])),
    ("src_type", pa.string()), ("src_name", pa.string()), ("method", pa.string()), ("raw", pa.string()), ("error", pa.string()),
])


def claim_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sources -> full batches of their claims."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    rows: list[tuple] = []
    for b in batches:
        for at, kind, name, content in zip(*(b[c].to_pylist() for c in ("source_ord", "type", "name", "content")), strict=True):
            found, error = read(kind, content or "")
            if error:
                rows.append((at, 0, None, None, None, None, None, None, kind, name, None, None, error))
            for k, (rec, path, v, method) in enumerate(found):
                if isinstance(v, str):
                    rows.append((at, rec, k, path, v, None, None, None, kind, name, method, v, None))
                else:
                    num = float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
                    raw = json.dumps(v, ensure_ascii=False, separators=(",", ":"))
                    rows.append((at, rec, k, path, None if num is None else number_text(num), num, v if path == "experience" else None, v if path == "education" else None, kind, name, method, raw, None))
                if len(rows) >= BATCH:
                    yield batch(rows)
                    rows = []
    if rows:
        yield batch(rows)


def extract(sources: DataFrame) -> DataFrame:
    """Claims of all sources, with record_id, seq and base confidence, and a row with ``error`` for each that an adapter could
    not read to its end (see ``split_errors``)."""
    out = sources.select("source_ord", "type", "name", "content").mapInArrow(lambda batches: claim_batches(batches), CLAIMS)
    return out.select(
        F.concat(F.col("src_type"), F.lit(":"), F.col("src_name"), F.lit("#"), F.col("record_idx").cast("string")).alias("record_id"),
        (F.shiftleft(F.col("source_ord"), 32) + F.col("record_idx")).alias("rec"), "*", base_confidence(F.col("src_type"), F.col("method")).alias("confidence"),
    )


def split_errors(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, failed): failed is (name, reason) of sources."""
    failed = extracted.where("error IS NOT NULL").select(F.col("src_name").alias("name"), F.col("error").alias("reason"))
    return extracted.where("error IS NULL").drop("error"), failed


for _module in (__name__, dims.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])  # executors need no copy of this package
