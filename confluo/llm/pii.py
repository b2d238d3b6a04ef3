"""Personal data: validated values are replaced by keyed pseudonyms of the same format.

Numbers and dates go through a Feistel network on their own domain (eight rounds, SHA-256 with a key), repeated until
the result is valid again (cycle walking). It is a permutation, so equal values stay linked across documents, and
unequal ones stay apart:

    card     13 to 19 digits, Luhn valid and of an issuer's range: all digits but the check digit, which is made anew
    phone    E.164 with +, or North American: all digits after the calling code, however they are grouped; a trunk zero
             in brackets, (0), stays (another single digit in brackets may become one that reads like it)
    ssn      valid area, group and serial: the nine digits
    ip       dotted quad, octets up to 255, and no version number: the 32 bits
    iban     mod-97 valid: the digits of the account, and the check digits made anew
    date     a real day from 1900 to 2099, in its written style (order, separator, one or two digits): year, month and
             day; a day is linked over all styles that can write every day

Texts without a format of fixed size get a keyed digest: an e-mail address becomes u<16 hex>@example.invalid, a password,
token or access key keeps its label (in any case, and after a prefix as in access_token) and length. What does not
validate stays as it is. All occurrences in the whole text are replaced. A card or phone candidate that took in
neighbouring groups of digits is parted from them (``_part``). Native: only DataFrame functions; no shuffle.

The key is a secret of the caller: who knows it can invert the permutations.

Defined results: null texts stay null, empty ones empty; very long texts are treated whole, in one row; repeated rows are
treated alike; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

DEMO_KEY = "confluo-pseudonyms"  # of the registered query, where the session sets none
KEY_CONF = "confluo.pii.key"
ROUNDS = 8
WALK = 128  # an invalid result is permuted again up to so many times; the chance to need more is below 1e-10

# The candidate patterns, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?<![\p{L}\p{N}])(?i:password|passwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-]{8,}+",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\p{L}\d._])(?<!\b(?i:version|ver\.?|v\.?|release|build|rev\.?|revision)[ :=]{1,2})\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w)+])\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
# Calling codes by their digits (every other one has three), and issuers' ranges of card numbers.
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ISSUERS = "|".join([
    r"4(?:\d{12}|\d{15}|\d{18})", r"5[1-5]\d{14}", r"2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}", r"3[47]\d{13}",
    r"3(?:0[0-59]|[689]\d)\d{11,16}", r"35(?:2[89]|[3-8]\d)\d{12,15}", r"6\d{12,18}", r"5[06-8]\d{11,17}",
])
CARD = r"\d(?:[ -]?\d){12,18}"
SHAPES = r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}"
WALLS = "\ufdd0\ufdd1\ufdd2\ufdd3"  # noncharacters; one that a text doesn't hold
ANY = "|".join(PATTERNS.values())
KINDS = list(PATTERNS)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once; inside loops nothing else would keep it from being computed anew."""
    return F.transform(F.array(value), body)[0]


def _fold(s: Column, start: Column, step) -> Column:
    """Left fold over the characters of ``s``: step(state, character, position from 1)."""
    return F.when(F.length(s) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), start, lambda a, i: step(a, _at(s, i), i))).otherwise(start)


def luhn(digits: Column) -> Column:
    """Luhn sum mod 10, for digits with the check digit."""

    def add(total: Column, d: Column, i: Column) -> Column:
        x = d.cast("int") * (1 + (F.length(digits) - i) % 2)
        return (total + x - F.when(x > 9, 9).otherwise(0)).cast("int")

    return _fold(digits, F.lit(0), add) % 10


def mod97(iban: Column) -> Column:
    """The number of an IBAN, moved round and with letters as 10 to 35, mod 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column, _: Column) -> Column:
        value = F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
        return ((rest * F.when(value > 9, 100).otherwise(10) + value) % 97).cast("int")

    return _fold(moved, F.lit(0), add)


def fill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced by ``digits`` one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(a: Column, c: Column, _: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        return F.struct(F.concat(a["out"], F.when(is_digit, _at(digits, a["k"])).otherwise(c)).alias("out"), (a["k"] + is_digit.cast("int")).alias("k"))

    return _fold(template, start, put)["out"]


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column, key: str) -> Column:
    """Eight rounds on the pair a < size_a, b < size_b; a struct(a, b)."""

    def turn(s: Column, i: Column) -> Column:
        f = lambda x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")
        even = i % 2 == 0
        left = F.when(even, (s["a"] + f(s["b"])) % size_a).otherwise(s["a"])
        right = F.when(even, s["b"]).otherwise((s["b"] + f(s["a"])) % size_b)
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def walk(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column, valid, key: str) -> Column:
    """``feistel`` until ``valid(a, b)``: a permutation of the valid pairs."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(False).alias("done"))

    def turn(s: Column, _: Column) -> Column:
        n = F.transform(F.array(feistel(s["a"], s["b"], size_a, size_b, tweak, key)), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), valid(x["a"], x["b"]).alias("done")))
        return F.when(s["done"], s).otherwise(n[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, turn)


def permute_digits(digits: Column, tweak: Column, valid, key: str) -> Column:
    """A permutation of digit strings of one length (2 to 36), split in half, kept within ``valid(digits)``."""
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    parts = F.struct(
        F.substring(digits, F.lit(1), h).cast("long").alias("a"), F.substring(digits, h + 1, n - h).cast("long").alias("b"), h.alias("h"), (n - h).alias("r"),
        size(h).alias("x"), size(n - h).alias("y"), F.concat_ws("|", tweak, n.cast("string")).alias("t"),
    )

    def run(p: Column) -> Column:
        join = lambda a, b: F.concat(F.lpad(a.cast("string"), p["h"], "0"), F.lpad(b.cast("string"), p["r"], "0"))
        return let(walk(p["a"], p["b"], p["x"], p["y"], p["t"], lambda a, b: let(join(a, b), valid), key), lambda x: join(x["a"], x["b"]))

    return let(parts, run)


def _number(s: Column, i: int, n: int) -> Column:
    return F.substring(s, i, n).cast("int")


def ssn_ok(d: Column) -> Column:
    area = _number(d, 1, 3)
    return (area > 0) & (area != 666) & (area < 900) & (_number(d, 4, 2) > 0) & (_number(d, 6, 4) > 0)


def nanp_ok(d: Column) -> Column:
    return d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")


def card_ok(d: Column) -> Column:
    return d.rlike(f"^(?:{ISSUERS})$") & (luhn(d) == 0)


def _always(_: Column) -> Column:
    return F.lit(True)


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        issued = lambda b: F.concat(b, F.lit("0")).rlike(f"^(?:{ISSUERS})$")
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), F.lit("card"), issued, key)
        whole = let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
        return F.when(card_ok(d), let(whole, lambda w: fill(m, w)))

    return let(_digits(m), made)


def _phone(m: Column, key: str) -> Column:
    """The same digits after the same calling code get the same pseudonym in every grouping."""
    plus = m.startswith("+")
    dialled = F.replace(m, F.lit("(0)"), F.lit("(_)"))

    def coded(d: Column) -> Column:
        code = F.when(plus, F.regexp_extract(d, CALLING, 0)).otherwise("")
        return let(F.struct(d.alias("d"), code.alias("code")), lambda p: let(F.struct(p["d"].alias("d"), p["code"].alias("code"), F.substring(p["d"], F.length(p["code"]) + 1, F.length(p["d"])).alias("rest")), made))

    def made(p: Column) -> Column:
        strict = p["code"].isin("", "1") & nanp_ok(p["rest"])
        loose = permute_digits(p["rest"], F.concat(F.lit("tel"), p["code"]), lambda d: (p["code"] != "1") | ~nanp_ok(d), key)
        new = F.when(strict, permute_digits(p["rest"], F.lit("nanp"), nanp_ok, key)).otherwise(loose)
        put = lambda w: F.replace(fill(dialled, w), F.lit("(_)"), F.lit("(0)"))
        return F.when(F.length(p["d"]).between(8, 15) & (plus | strict), let(F.concat(p["code"], new), put))

    return let(_digits(dialled), coded)


def _ip(m: Column, key: str) -> Column:
    hi = lambda x: F.floor(x / 256).cast("string")
    lo = lambda x: (x % 256).cast("string")

    def made(o: Column) -> Column:
        s = walk(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("ip"), lambda a, b: F.lit(True), key)
        return F.when(F.forall(o, lambda x: x <= 255), let(s, lambda x: F.concat_ws(".", hi(x["a"]), lo(x["a"]), hi(x["b"]), lo(x["b"]))))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), made)


def _date(m: Column, key: str) -> Column:
    """Dates as pairs of a month from 1900 on (of ``months`` a year that the style can write) and a day (of ``days`` from
    ``low`` on). Slashes mean month/day/year where that is a day, else day/month/year, whose days start at 13."""
    part = lambda i: F.regexp_extract(m, r"(\d+)\D(\d+)\D(\d+)", i)
    length = lambda y, mo: F.dayofmonth(F.last_day(F.make_date(y, mo, F.lit(1))))

    def real(y: Column, mo: Column, d: Column) -> Column:
        y, mo, d = (x.cast("int") for x in (y, mo, d))
        return F.when(y.between(1900, 2099) & mo.between(1, 12), d.between(1, length(y, mo))).otherwise(False)

    def read(f: Column) -> Column:
        iso, slash = F.substring(m, 5, 1) == "-", F.instr(m, "/") > 0
        mdy = slash & real(f[2], f[0], f[1])
        order = F.when(iso, "ymd").when(mdy, "mdy").when(slash, "dmy/").otherwise("dmy.")
        year, month = F.when(iso, f[0]).otherwise(f[2]), F.when(mdy, f[0]).otherwise(f[1])
        return F.struct(order.alias("order"), year.alias("y"), month.alias("m"), F.when(iso, f[2]).when(mdy, f[1]).otherwise(f[0]).alias("d"))

    def sized(p: Column) -> Column:
        months, low = F.when(F.length(p["m"]) == 1, 9).otherwise(12), F.when(p["order"] == "dmy/", 13).otherwise(1)
        days = F.when(p["order"] == "dmy/", 19).when(F.length(p["d"]) == 1, 9).otherwise(31)
        return F.struct(p["order"].alias("order"), p["y"].alias("y"), p["m"].alias("m"), p["d"].alias("d"), months.alias("months"), days.alias("days"), low.alias("low"))

    def made(p: Column) -> Column:
        year, month = lambda a: (1900 + F.floor(a / p["months"])).cast("int"), lambda a: (a % p["months"] + 1).cast("int")
        a, b = (p["y"].cast("int") - 1900) * p["months"] + p["m"].cast("int") - 1, p["d"].cast("int") - p["low"]
        tweak = F.concat_ws("|", F.lit("date"), p["months"].cast("string"), p["days"].cast("string"), p["low"].cast("string"))
        s = walk(a, b, 200 * p["months"], p["days"], tweak, lambda a, b: b + p["low"] <= length(year(a), month(a)), key)
        return F.when(real(p["y"], p["m"], p["d"]) & (p["d"].cast("int") >= p["low"]), let(s, lambda x: written(p, year(x["a"]), month(x["a"]), x["b"] + p["low"])))

    def written(p: Column, y: Column, mo: Column, d: Column) -> Column:
        y, mo, d = y.cast("string"), F.lpad(mo.cast("string"), F.length(p["m"]), "0"), F.lpad(d.cast("string"), F.length(p["d"]), "0")
        return F.when(p["order"] == "ymd", F.concat_ws("-", y, mo, d)).when(p["order"] == "mdy", F.concat_ws("/", mo, d, y)).when(p["order"] == "dmy/", F.concat_ws("/", d, mo, y)).otherwise(F.concat_ws(".", d, mo, y))

    return let(F.array(part(1), part(2), part(3)), lambda f: let(read(f), lambda p: let(sized(p), made)))


def _iban(m: Column, key: str) -> Column:
    body = F.substring(m, F.lit(5), F.length(m))
    new = let(_digits(body), lambda d: F.when(F.length(d) >= 2, let(permute_digits(d, F.lit("iban"), _always, key), lambda w: fill(body, w))).otherwise(body))

    def whole(b: Column) -> Column:
        check = 98 - mod97(F.concat(F.substring(m, 1, 2), F.lit("00"), b))
        return F.concat(F.substring(m, 1, 2), F.lpad(check.cast("string"), 2, "0"), b)

    return F.when(mod97(m) == 1, let(new, whole))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)).cast("binary"), 256), 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"(?:AKIA|[=:]\s*[\"']?)(.*)$", 1)
    digest = F.sha2(F.concat(F.lit(f"{key}|secret|"), value).cast("binary"), 256)
    made = F.substring(F.repeat(F.when(m.startswith("AKIA"), F.upper(digest)).otherwise(digest), (F.length(value) / 64 + 1).cast("int")), F.lit(1), F.length(value))
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), made)


def _ssn(m: Column, key: str) -> Column:
    return let(_digits(m), lambda d: F.when(ssn_ok(d), let(permute_digits(d, F.lit("ssn"), ssn_ok, key), lambda w: fill(m, w))))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, or null where it does not validate."""
    out = None
    for kind in KINDS:
        test = m.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(test, MAKERS[kind](m, key)) if out is None else out.when(test, MAKERS[kind](m, key))
    return out


def _part(m: Column) -> Column:
    """struct(begin, n) of what validates within a card or phone candidate that took in other groups of digits, or null.
    Of cards the longest valid prefix that ends at a separator, or else the first valid run of groups in the shape of a card;
    of phones the number of ten digits after +1, or the longest prefix of up to 15 digits where there are more."""
    size = F.length(m)
    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    digit = lambda i: _at(m, i).rlike("[0-9]")
    text = lambda r: F.substring(m, r["begin"], r["n"])
    begins = F.filter(places, lambda i: digit(i) & ((i == 1) | ~digit(i - 1)))
    ends = F.reverse(F.filter(places, lambda i: digit(i) & (i < size) & ~digit(i + 1)))
    runs = lambda b, to: F.transform(to, lambda e: F.struct(b.alias("begin"), (e - b + 1).alias("n")))
    prefixes = runs(F.lit(1), ends)
    inner = F.flatten(F.transform(F.filter(begins, lambda b: b > 1), lambda b: runs(b, F.concat(F.array(size), ends))))
    card = F.concat(F.filter(prefixes, lambda r: text(r).rlike(f"^{CARD}$")), F.filter(inner, lambda r: text(r).rlike(f"^(?:{SHAPES})$")))
    good = F.filter(card, lambda r: let(_digits(text(r)), card_ok))
    tel = F.transform(prefixes, lambda r: F.struct(r["begin"].alias("begin"), r["n"].alias("n"), _digits(text(r)).alias("d")))
    nanp = F.filter(tel, lambda r: r["d"].rlike("^1[0-9]{10}$"))
    many = F.when(F.length(_digits(m)) > 15, F.filter(tel, lambda r: F.length(r["d"]).between(8, 15))).otherwise(F.slice(tel, 1, 0))
    phone = F.get(F.concat(nanp, many), F.lit(0))
    of_phone = F.when(phone.isNotNull(), F.struct(phone["begin"].alias("begin"), phone["n"].alias("n")))
    return F.when(m.rlike(f"^{CARD}$"), F.when(~let(_digits(m), card_ok), F.get(good, F.lit(0)))).when(m.startswith("+") & ~m.contains("@"), of_phone)


def _apart(t: Column, wall: Column) -> Column:
    """``t`` with ``wall`` on both sides of each ``_part``, so that it and what is beside it are candidates of their own;
    repeated until nothing changes, as a wall can bring up new candidates."""

    def put(m: Column) -> Column:
        cut = lambda r: F.concat(F.substring(m, F.lit(1), r["begin"] - 1), wall, F.substring(m, r["begin"], r["n"]), wall, F.substring(m, r["begin"] + r["n"], F.length(m)))
        return F.coalesce(let(_part(m), cut), m)

    def turn(s: Column, _: Column) -> Column:
        made = let(F.regexp_extract_all(s["t"], F.lit(ANY), F.lit(0)), lambda f: F.array_join(F.zip_with(F.split(s["t"], ANY, -1), F.concat(F.transform(f, put), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""))
        return F.when(s["done"], s).otherwise(let(made, lambda x: F.struct(x.alias("t"), (x == s["t"]).alias("done"))))

    rounds = F.floor(F.length(t) / 8).cast("int") + 2  # each takes 8 digits at least
    return F.aggregate(F.sequence(F.lit(1), rounds), F.struct(t.alias("t"), F.lit(False).alias("done")), turn)["t"]


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with replaced ``text`` and two more columns: n_candidates and n_replaced."""
    t = F.col("__t")
    none = F.array().cast("array<string>")
    scan = lambda c: F.coalesce(F.when(c.rlike("[0-9@=:]"), F.regexp_extract_all(c, F.lit(ANY), F.lit(0))), none)
    df = docs.withColumn("__first", scan(F.col(text)))
    df = df.withColumn("__crowd", F.exists("__first", lambda m: _part(m).isNotNull()))
    df = df.withColumn("__wall", F.when(F.col("__crowd"), F.coalesce(*[F.when(~F.col(text).contains(c), c) for c in WALLS])))
    df = df.withColumn("__t", F.when(F.col("__wall").isNotNull(), _apart(F.col(text), F.col("__wall"))).otherwise(F.col(text)))
    df = df.withColumn("__found", F.when(F.col("__wall").isNotNull(), scan(t)).otherwise(F.col("__first")))
    df = df.withColumn("__new", F.transform("__found", lambda m: pseudonym(m, key)))
    pairs = F.arrays_zip(F.col("__found").alias("m"), F.col("__new").alias("p"))
    made = F.transform(pairs, lambda x: F.coalesce(x["p"], x["m"]))
    whole = F.array_join(F.zip_with(F.split(t, ANY), F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    whole = F.when(F.col("__wall").isNotNull(), F.replace(whole, F.col("__wall"), F.lit(""))).otherwise(whole)
    replaced = F.size(F.filter("__new", lambda p: p.isNotNull()))
    out = df.withColumns({"__text": F.when(F.size("__found") > 0, whole).otherwise(F.col(text)), "n_candidates": F.size("__found"), "n_replaced": replaced})
    return out.select(*[F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_candidates", "n_replaced")], "n_candidates", "n_replaced")


def session_key(spark) -> str:
    """The key of the registered queries: the session's, or else the one for demonstration."""
    return spark.conf.get(KEY_CONF, DEMO_KEY)


def op7_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
