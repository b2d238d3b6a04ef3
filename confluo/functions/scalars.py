"""Scalar normalizers as Column expressions. What can't be normalized becomes null, never a guess.

A value that an expression needs more than once is bound by ``let``: the plan holds it once, and each row computes it once.
Without that, nested normalizers grow to trees that are slow to analyse and too large to compile.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import dims

E164, ISO2, YEAR_MONTH = r"^\+[1-9][0-9]{6,14}\z", r"^[A-Z]{2}\z", r"^[0-9]{4}-(0[1-9]|1[0-2])\z"
EMAIL = r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+\z"
BLANK = r"[\s\uFEFF]"
SUFFIX_WORDS = "|".join(dims.COMPANY_SUFFIXES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def trim(c: Column) -> Column:
    """Strip every Unicode blank at both ends, not spaces only."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){BLANK}+", " ")


def none_if_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """A constant dictionary; null where the key is absent."""
    table = F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")  # folded to a literal, in one call
    return F.try_element_at(table, key)


def clean_text(c: Column) -> Column:
    return none_if_empty(trim(collapse(c)))


def is_blank(c: Column) -> Column:
    return c.isNull() | F.lower(trim(c)).isin(dims.BLANKS)


def split_list(c: Column, bullets: bool = False) -> Column:
    parts = F.split(c, "[,;\\n|•·]+" if bullets else "[,;\\n|]+")
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def round4(c: Column) -> Column:
    return F.floor(c * F.lit(1e4) + F.lit(0.5)).cast("double") / F.lit(1e4)


def clamp01(c: Column) -> Column:
    return F.when(F.isnan(c), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def base_confidence(source: Column, method: Column) -> Column:
    pick = lambda table, c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])
    return round4(clamp01(pick(dims.SOURCE_TRUST, source) * pick(dims.METHOD_TRUST, method)))


def noisy_or(values: Column) -> Column:
    """round4(1 - product of (1 - c)); 0 for an empty array."""
    miss = F.aggregate(values, F.lit(1.0), lambda a, c: a * (F.lit(1.0) - clamp01(c)))
    return F.when(F.size(values) == 0, 0.0).otherwise(round4(clamp01(F.lit(1.0) - miss)))


def normalize_email(c: Column) -> Column:
    bare = trim(F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "^mailto:", ""), r"^<(.*)>\z", "$1"))
    return let(bare, lambda v: F.when(v.rlike(EMAIL), v))


def title_case(c: Column) -> Column:
    """Capitals after the start of a word, a hyphen or an apostrophe; ASCII only."""

    def cased(letters: Column) -> Column:
        starts = lambda i: (i == 0) | F.get(letters, i - 1).isin(" ", "-", "'")
        return F.array_join(F.transform(letters, lambda ch, i: F.when(starts(i) & ch.rlike("^[a-z]$"), F.upper(ch)).otherwise(ch)), "")

    return let(F.split(F.lower(c), ""), cased)


def normalize_name(c: Column) -> Column:
    swap = r"(?s)^([^,]+),[\s]*([^,]+)\z"
    turned = lambda v: F.when(v.rlike(swap), F.concat(trim(F.regexp_extract(v, swap, 2)), F.lit(" "), trim(F.regexp_extract(v, swap, 1)))).otherwise(v)
    ends = lambda v: trim(collapse(F.regexp_replace(v, r"(?U)^[,;\s\uFEFF]+|[,;\s\uFEFF]+\z", "")))
    cased = lambda v: F.when(v.rlike(r"\p{L}") & ~v.contains("@") & ~v.rlike("(?i)https?://"), F.when(v == F.upper(v), title_case(v)).otherwise(v))
    return let(trim(F.regexp_replace(trim(c), "^[\"'`]+|[\"'`]+\\z", "")), lambda v: let(ends(turned(v)), cased))


def _unmarked(ch: str) -> str:
    return re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", ch))


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that fold to one ASCII letter, digit or blank, and those that fold to several characters with such."""
    all_ = {chr(i): _unmarked(chr(i)) for i in range(0x80, 0x1F200) if not 0xD800 <= i < 0xE000 and unicodedata.decomposition(chr(i))}
    some = {k: v for k, v in all_.items() if re.search("[A-Za-z0-9\\s]", v)}
    return {k: v for k, v in some.items() if len(v) == 1}, {k: v for k, v in some.items() if len(v) > 1}


ONE_FOLD, MORE_FOLDS = _folds()


def fold_marks(c: Column) -> Column:
    """NFKD without combining marks, as far as ASCII letters, digits and blanks come of it."""
    one = F.translate(F.regexp_replace(c, "[\u0300-\u036f]", ""), "".join(ONE_FOLD), "".join(ONE_FOLD.values()))
    more = lambda v: F.array_join(F.transform(F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0)), lambda ch: F.coalesce(lookup(MORE_FOLDS, ch), ch)), "")
    return let(one, lambda v: F.when(v.rlike(f"[{''.join(map(re.escape, MORE_FOLDS))}]"), more(v)).otherwise(v))


def name_key(c: Column) -> Column:
    """Folded name for matching."""
    folded = F.when(c.rlike(r"^[\x00-\x7F]*\z"), c).otherwise(fold_marks(c))
    return F.coalesce(trim(F.regexp_replace(F.regexp_replace(F.lower(folded), r"[^a-z0-9\s]", " "), r"\s+", " ")), F.lit(""))


def normalize_phone(c: Column, default_country: str | None = None) -> Column:
    """E.164, from a + or 00 prefix or a hinted country, if the calling code's plan has such a number."""
    hint = (default_country or "").strip().upper()
    code = next((k for k, (region, _) in dims.CALLING.items() if region == hint or (k == "1" and hint == "CA")), None)
    wide = rf"^(?:{'|'.join(f'{k}(?:{p})' for k, (_, p) in dims.CALLING.items())})\z"

    def planned(digits: Column) -> Column:
        trunk = F.regexp_replace(digits, r"^(4[0-9]|33|61|81|82)0", "$1")
        return F.when(digits.rlike(wide), digits).otherwise(let(trunk, lambda t: F.when(t.rlike(wide), t)))

    def at_home(digits: Column) -> Column:
        if not code:
            return F.lit(None).cast("string")
        full = F.concat(F.lit(code), F.regexp_replace(digits, "^0", ""))
        return let(full, lambda f: F.when(f.rlike(wide), f).when(digits.startswith(code) & digits.rlike(wide), digits))

    def number(v: Column) -> Column:
        digits = F.regexp_replace(F.when(v.startswith("00"), F.substring(v, F.lit(3), F.length(v))).otherwise(v), "[^0-9]", "")
        intl = v.startswith("+") | v.startswith("00")
        return let(digits, lambda d: F.concat(F.lit("+"), F.when(intl, planned(d)).otherwise(at_home(d))))

    bare = F.regexp_replace(trim(F.regexp_replace(trim(c), "(?i)^tel:", "")), r"(?i)\s*(?:ext\.?|x|#)\s*[0-9]+\z", "")
    return let(bare, lambda v: F.when(v.rlike(r"^[+0-9(][0-9\s().\-/ ]*\z"), number(v)))


_countries: dict[str, str] = {}


def country_table(spark: SparkSession) -> dict[str, str]:
    """Lower-case code or English name -> alpha-2, from the ISO 3166 table of the Java platform; asked for once."""
    if not _countries:
        locale = spark._jvm.java.util.Locale
        out: dict[str, str] = {}
        for code in locale.getISOCountries():
            where = locale("", code)
            out[where.getDisplayCountry(locale.ENGLISH).lower()] = code
            out[where.getISO3Country().lower()] = code
            out[code.lower()] = code
        _countries.update({**out, **dims.COUNTRY_ALIASES})
    return _countries


def normalize_country(c: Column, table: dict[str, str]) -> Column:
    return lookup(table, F.lower(trim(c)))


def normalize_month(c: Column) -> Column:
    iso, us, named = r"^([0-9]{4})[-/]([0-9]{1,2})(?:[-/][0-9]{1,2})?\z", r"^([0-9]{1,2})[-/]([0-9]{4})\z", r"^([a-z]+)\.?,?\s+([0-9]{4})\z"
    names = {m: f"{i:02d}" for i, m in enumerate(dims.MONTHS, 1)} | {m[:3]: f"{i:02d}" for i, m in enumerate(dims.MONTHS, 1)} | {"sept": "09"}

    def month(v: Column) -> Column:
        part = lambda p, i: F.regexp_extract(v, p, i)
        make = lambda y, m: F.when(m.cast("int").between(1, 12), F.concat(y, F.lit("-"), F.lpad(m.cast("int").cast("string"), 2, "0")))
        spelled = F.when(v.rlike(named), F.concat(part(named, 2), F.lit("-"), lookup(names, part(named, 1))))
        return F.when(v.rlike(iso), make(part(iso, 1), part(iso, 2))).when(v.rlike(us), make(part(us, 2), part(us, 1))).otherwise(spelled)

    return let(F.lower(trim(c)), month)


def normalize_end(c: Column) -> Column:
    return F.when(F.lower(trim(c)).isin(dims.ONGOING), "present").otherwise(normalize_month(c))


def extract_year(c: Column) -> Column:
    return none_if_empty(F.regexp_extract(c, r"\b(19[0-9]{2}|20[0-9]{2}|2100)\b", 1)).cast("int")


def skill_fold(c: Column) -> Column:
    return trim(collapse(F.lower(c)))


def normalize_skill(c: Column) -> Column:
    """struct(name, canonical)."""
    table = {k.lower(): k for k in dims.SKILLS} | {a: k for k, other in dims.SKILLS.items() for a in other}
    bare = lambda f: trim(F.regexp_replace(f, r"\s+v?[0-9]+(\.[0-9]+)*\z", ""))
    known = lambda f: F.coalesce(lookup(table, f), lookup(table, bare(f)))
    named = lambda v, hit: F.struct(F.coalesce(hit, v).alias("name"), hit.isNotNull().alias("canonical"))
    found = lambda v: let(let(skill_fold(v), known), lambda hit: named(v, hit))
    return let(trim(F.regexp_replace(trim(collapse(c)), r"[.,;]+\z", "")), lambda v: F.when(F.length(v) > 0, found(v)))


URL = r"(?i)^([a-z][a-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:@\s]+)(?::([0-9]*))?([^?#]*)"


def normalize_url(c: Column) -> Column:
    def parsed(raw: Column) -> Column:
        part = lambda i: F.regexp_extract(raw, URL, i)
        fields = F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("host"), part(3).alias("port"), F.regexp_replace(part(4), " ", "%20").alias("path"))
        return let(fields, lambda u: F.when(raw.rlike(URL), built(u)))

    def built(u: Column) -> Column:
        host = F.regexp_replace(F.lower(u["host"]), r"^www\.", "")
        port = F.when(u["port"].isin("", "443") | ((u["port"] == "80") & (u["scheme"] == "http")), "").otherwise(F.concat(F.lit(":"), u["port"]))
        ok = u["scheme"].isin("http", "https") & ~u["host"].rlike(r"[<>\[\]^|%\\]")
        whole = lambda h: F.when(u["path"].isin("", "/"), F.concat(F.lit("https://"), h)).otherwise(F.concat(F.lit("https://"), h, port, F.regexp_replace(u["path"], r"/\z", "")))
        return let(host, lambda h: F.when(ok & h.contains("."), whole(h)))

    full = lambda raw: F.when(raw.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    return let(trim(c), lambda raw: F.when(F.length(raw) > 0, let(full(raw), parsed)))


def url_host(c: Column) -> Column:
    return F.regexp_extract(c, r"^https://([^/:]+)", 1)


def classify_url(c: Column) -> Column:
    def kind(host: Column) -> Column:
        under = lambda d: (host == d) | host.endswith("." + d)
        return F.when(under("linkedin.com"), "linkedin").when(under("github.com"), "github").when(host.endswith(".github.io"), "portfolio").otherwise("other")

    return let(normalize_url(c), lambda url: F.when(url.isNotNull(), let(url_host(url), kind)))


def github_handle(c: Column) -> Column:
    handle = F.lower(F.regexp_extract(normalize_url(c), r"^https://github\.com(?::[0-9]+)?/+([^/]+)", 1))
    return let(handle, lambda h: F.when(h.rlike(r"^[a-z0-9](?:[a-z0-9]|-(?=[a-z0-9])){0,38}\z") & ~h.isin(dims.RESERVED_HANDLES), h))


def parse_years(text: Column) -> Column:
    n = none_if_empty(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1)).try_cast("double")
    return let(n, lambda x: F.when(x.between(0, 80), F.floor(x + 0.5).cast("double")))


def fold_company(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), rf"\b({SUFFIX_WORDS})\b", ""), "[^a-z0-9]+", "")


def upper_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Z]", ""))


def fnv1a64(c: Column) -> Column:
    """FNV-1a over UTF-8 bytes as 16 hex digits, in 32-bit halves, so that nothing overflows."""
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    low32 = F.lit(0xFFFFFFFF).cast("long")

    def step(s: Column, pair: Column) -> Column:
        lo = s["lo"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        mixed = lambda x: F.struct((s["hi"] * 435 + x * 256 + F.shiftright(x * 435, 32)).bitwiseAND(low32).alias("hi"), (x * 435).bitwiseAND(low32).alias("lo"))
        return let(lo, mixed)

    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0))
    digits = lambda s: F.lower(F.concat(*[F.lpad(F.hex(s[k]), 8, "0") for k in ("hi", "lo")]))
    return let(F.aggregate(pairs, start, step), digits)


def candidate_id(seed: Column) -> Column:
    return F.concat(F.lit("cand_"), fnv1a64(F.lower(trim(seed))))

