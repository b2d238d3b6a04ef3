"""Personal data against a plain-Python version, and the promises about links."""

import calendar
import datetime
import hashlib
import random

import pytest
import regex

from confluo.llm import pii

KEY = "a key"


def walk(a, b, size_a, size_b, tweak, valid):
    while True:
        for i in range(pii.ROUNDS):
            f = lambda x, i=i: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)
            a, b = ((a + f(b)) % size_a, b) if i % 2 == 0 else (a, (b + f(a)) % size_b)
        if valid(a, b):
            return a, b


def permute(d, tweak, valid=lambda _: True):
    h, n = len(d) // 2, len(d)
    join = lambda a, b: f"{a:0{h}d}{b:0{n - h}d}"
    return join(*walk(int(d[:h]), int(d[h:]), 10**h, 10 ** (n - h), f"{tweak}|{n}", lambda a, b: valid(join(a, b))))


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10


def fill(template, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def issued(d):
    return regex.fullmatch(pii.ISSUERS, d) is not None


def nanp(d):
    return regex.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", d) is not None


def card(m):
    d = fill(regex.sub(r"\D", "", m), regex.sub(r"\D", "", m))
    if not issued(d) or luhn(d):
        return m
    body = permute(d[:-1], "card", lambda x: issued(x + "0"))
    return fill(m, body + str((10 - luhn(body + "0")) % 10))


def phone(m):
    held = m.replace("(0)", "(_)")
    d = regex.sub(r"\D", "", held)
    code = regex.match(pii.CALLING, d)[0] if m[0] == "+" else ""
    rest = d[len(code) :]
    if code in ("", "1") and nanp(rest):
        new = permute(rest, "nanp", nanp)
    elif m[0] == "+" and 8 <= len(d) <= 15:
        new = permute(rest, "tel" + code, lambda x: code != "1" or not nanp(x))
    else:
        return m
    return fill(held, code + new).replace("(_)", "(0)")


def date(m):
    f = regex.split(r"\D", m)
    if m[4] == "-":
        order, (y, mo, d) = "ymd", f
    elif "." in m:
        order, (d, mo, y) = "dmy.", f
    else:
        order, (mo, d, y) = "mdy", f
        if not (1 <= int(mo) <= 12 and 1 <= int(d) <= calendar.monthrange(int(y), int(mo))[1]):
            order, (d, mo, y) = "dmy/", f
    if not (1900 <= int(y) <= 2099 and 1 <= int(mo) <= 12 and 1 <= int(d) <= calendar.monthrange(int(y), int(mo))[1]):
        return m
    months, low = 9 if len(mo) == 1 else 12, 13 if order == "dmy/" else 1
    days = 19 if order == "dmy/" else 9 if len(d) == 1 else 31
    a, b = walk((int(y) - 1900) * months + int(mo) - 1, int(d) - low, 200 * months, days, f"date|{months}|{days}|{low}", lambda a, b: b + low <= calendar.monthrange(1900 + a // months, a % months + 1)[1])
    y, mo, d = str(1900 + a // months), f"{a % months + 1:0{len(mo)}d}", f"{b + low:0{len(d)}d}"
    return {"ymd": f"{y}-{mo}-{d}", "mdy": f"{mo}/{d}/{y}", "dmy/": f"{d}/{mo}/{y}", "dmy.": f"{d}.{mo}.{y}"}[order]


def ip(m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return m
    a, b = walk(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", lambda a, b: True)
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def ssn(m):
    ok = lambda d: d[:3] not in ("000", "666") and d < "9" and d[3:5] != "00" and d[5:] != "0000"
    d = m.replace("-", "")
    return fill(m, permute(d, "ssn", ok)) if ok(d) else m


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def iban(m):
    if mod97(m) != 1:
        return m
    d = regex.sub(r"\D", "", m[4:])
    body = fill(m[4:], permute(d, "iban")) if len(d) > 1 else m[4:]
    return f"{m[:2]}{98 - mod97(m[:2] + '00' + body):02d}{body}"


def email(m):
    return f"u{hashlib.sha256(f'{KEY}|email|{m.lower()}'.encode()).hexdigest()[:16]}@example.invalid"


def secret(m):
    value = regex.search(r"(?:AKIA|[=:]\s*[\"']?)(.*)$", m)[1]
    digest = hashlib.sha256(f"{KEY}|secret|{value}".encode()).hexdigest()
    digest = digest.upper() if m.startswith("AKIA") else digest
    return m[: len(m) - len(value)] + (digest * (len(value) // 64 + 1))[: len(value)]


MAKERS = {"email": email, "secret": secret, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}
ANY = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()))


def brute(text):
    return None if text is None else ANY.sub(lambda m: MAKERS[m.lastgroup](m[0]), text)


def new(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]


def test_against_plain_python(spark):
    r = random.Random(12)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    made = {
        "card": lambda: (lambda b: b + str((10 - luhn(b + "0")) % 10) if r.random() < 0.9 else b + "0")(r.choice(["4", "51", "37", "6011", "9", "2221"]) + n(11)),
        "phone": lambda: r.choice([f"+1 ({n(3)}) 555-{n(4)}", f"+49 {n(2)} {n(4)} {n(4)}", f"+353 {n(1)} {n(3)} {n(4)}", f"+7{n(10)}", f"+44 (0){n(2)} {n(4)} {n(4)}", f"({n(3)}) {n(3)}-{n(4)}"]),
        "ssn": lambda: f"{n(3)}-{n(2)}-{n(4)}",
        "ip": lambda: ".".join(str(r.randrange(300)) for _ in range(4)),
        "date": lambda: r.choice([f"{r.randrange(1890, 2110)}-{r.randrange(14):02d}-{r.randrange(33):02d}", f"{r.randrange(14)}/{r.randrange(32)}/{r.randrange(1900, 2100)}", f"{r.randrange(32):02d}.{r.randrange(1, 13)}.{r.randrange(1900, 2100)}"]),
        "iban": lambda: (lambda c, b: f"{c}{98 - mod97(c + '00' + b):02d}{b}" if r.random() < 0.8 else f"{c}00{b}")(r.choice(["GB", "DE"]), r.choice(["WEST", ""]) + n(14)),
        "email": lambda: f"{r.choice(['Ana', 'bob.c'])}{n(2)}@Mail{n(1)}.example.com",
        "secret": lambda: r.choice(['token = "', "PASSWORD:", "x_api-key="]) + hashlib.sha256(n(5).encode()).hexdigest()[: r.choice([6, 20, 64])],
    }
    texts = [" ".join(w for _ in range(6) for w in (r.choice(["wörd", "a,", "end.\n", "(b)"]), made[k]())) + " z" for k in made for _ in range(25)]
    texts += ["", None, "no data", "v1.2.3.4 and build 10.0.0.1, version: 2.3.4.5", "9" * 40, ("x " * 20_000) + "4041894974608795"]
    for text, got in zip(texts, new(spark, texts), strict=True):
        assert got == brute(text)


def test_spellings_of_a_phone_stay_linked(spark):
    groups = [["+7 916 123 4567", "+79161234567", "+7 (916) 123-45-67", "+7-916-123-4567"], ["+353 1 234 5678", "+35312345678", "+353 (1) 2345678"], ["+44 (0)20 7946 0958", "+442079460958", "+44 20 7946 0958"], ["+1 (988) 555-2485", "988-555-2485", "+19885552485", "(988) 555-2485"], ["+33 6 12 34 56 78", "+33612345678"]]
    texts = [t for g in groups for t in g]
    out = iter(new(spark, texts))
    seen = set()
    for g in groups:
        trunk = lambda t, x: x.replace("(0)", "") if "(0)" in t else x
        digits = {regex.sub(r"^1(?=\d{10}$)", "", regex.sub(r"\D", "", trunk(t, next(out)))) for t in g}
        assert len(digits) == 1 and digits.isdisjoint({regex.sub(r"\D", "", t.replace("(0)", "")) for t in g})
        seen |= digits
    assert len(seen) == len(groups)


@pytest.mark.parametrize("style", ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "{m}/{d}/%Y", "{d}.{m}.%Y"])
def test_dates_are_one_to_one_in_each_style(spark, style):
    days = [datetime.date(1983, 1, 1) + datetime.timedelta(k) for k in range(1200)]
    texts = sorted({d.strftime(style.format(m=d.month, d=d.day)) for d in days})
    out = new(spark, texts)
    assert len(set(out)) == len(texts)
    for a, b in zip(texts, out, strict=True):
        assert regex.sub(r"\d", "9", a) == regex.sub(r"\d", "9", b)


def test_numbers_are_one_to_one(spark):
    texts = [f"+1 201 {x} {y:04d}" for x in ("155", "555") for y in range(300)] + [f"1.2.{k}.4" for k in range(256)] + [f"123-45-{k:04d}" for k in range(1, 300)]
    cards = [b + str((10 - luhn(b + "0")) % 10) for b in (f"37828224631{k:03d}" for k in range(300))]
    out = new(spark, texts + cards)
    assert len(set(out)) == len(texts) + len(cards) and not set(out) & set(cards) and all(luhn(x) == 0 and issued(x) for x in out[-300:])


def test_a_key_is_needed(spark):
    with pytest.raises(TypeError):
        pii.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
