"""URL filter, decontamination, personal data and chat formatting."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from confluo.llm import chat, decontaminate, pii, url_filter
from confluo.llm.url_filter import Rule

URLS = ["https://a.EXAMPLE.com/en/7x?q", "http://example.com/en/8", "http://b.net/de/", "http://example.net/de/88#f", "https://x.org/es/1", "https://xorg/es/1", None, "", "no scheme", "http://", "http://com/en/", "http://h.com", "HTTP://Z.com/EN/", "a://b://c.com/en/"]


def brute(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.text), r.text, r.verdict), default=None)
    return host, path, best and best.text, best.verdict if best else default


@pytest.mark.parametrize("inline", [512, 0])
def test_url_filter(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE_RULES", inline)
    r = random.Random(3)
    urls = URLS + [f"https://{r.choice(['m.', ''])}{r.choice(['example', 'spam-farm', 'x'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es', 'e'])}/{r.randrange(99)}" for _ in range(150)]
    rules = [*url_filter.RULES, Rule("block", "farm.org"), Rule("allow", "", "/es/4")]
    df = spark.createDataFrame([(i, u, "old", "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string, other string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(df, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), rules).count() == 0 and url_filter.judge(df, []).where("verdict <> 'allow'").count() == 0


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


@pytest.mark.parametrize(("anchors", "sent"), [(50_000, 500_000), (0, 0)])
def test_decontaminate(spark, monkeypatch, anchors, sent):
    monkeypatch.setattr(decontaminate, "MAX_ANCHORS", anchors)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", sent)
    r = random.Random(5)
    vocab = ["ab", "the", "Être", "x1", "lorem", "ipsum", "dolor"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    tests = [(1, text(20)), (2, text(3)), (3, text(13)), (None, "ab lorem"), (5, None), (6, "?!"), (1, text(14))]
    docs = [(i, text(r.randrange(40)) + " " + r.choice([t or "" for _, t in tests]).upper() + "." + text(r.randrange(30))) for i in range(30)] + [(30, None), (31, ""), (0, "ab lorem"), (0, "ab lorem")]
    n = 13
    sets = {}
    for item, t in tests:
        w = words(t)
        for i in range(max(0, len(w) - n + 1) or bool(w)):
            sets.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    want = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for i in range(len(w)):
            for k in {len(g) for g in sets}:
                g = tuple(w[i : i + k])
                if len(g) == k and g in sets:
                    hit |= set(range(i, i + k))
                    items |= sets[g]
        want.append((d, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = [(x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in decontaminate.report(df, bench).collect()]
    assert sorted(got) == sorted(want)
    if anchors:
        kept = decontaminate.drop_contaminated(df, bench)
        bad = {d for d, *_, c in want if c}
        assert kept.columns == df.columns and kept.count() == sum(d not in bad for d, _ in docs)
        assert not decontaminate.report(df.limit(0), bench).count() and not decontaminate.report(df, bench.limit(0)).where("n_hit > 0").count()
        cleaned = decontaminate.drop_spans(df, bench)
        assert cleaned.count() == len(docs) and decontaminate.report(df.where("doc_id = 31"), bench).first().n_hit == 0


def test_passages_are_cut_out(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = " ".join(f"Ünd-w{i}," for i in range(400))
    half = len(long) // 2 + 3
    half = long.index("Ü", half)
    docs = [(1, long[:half] + passage.upper() + ".\n " + long[half:], 5), (2, f"x {passage} y", 5), (3, long, 5), (1, long + " Z", 5), (None, passage + "! " + long, 5), (4, None, 5), (5, "", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([("a", passage)], "item_id string, text string")
    out = decontaminate.clean(df, bench)
    key = lambda r: (r[0] or 0, r[1] or "")
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=key) == sorted([(1, long, 5), (3, long, 5), (1, long + " Z", 5), (None, long, 5), (4, None, 5), (5, "", 5)], key=key)
    assert decontaminate.report(out, bench).where("n_hit > 0").count() == 0


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    card = "4041894974608795"
    texts = [f"a {card} b", "x 4041 8949 7460 8795", "4041894974608796", "+1 (988) 555-2485.", "write to A.b@Mail.Example.com now", "1.2.3.4 and 300.1.1.1", "123-45-6789 000-12-1234", "1984-02-29 1985-02-29", "GB82WEST12345698765432 GB82WEST12345698765433", "", None, "clean words only", "9" * 3000]
    df = spark.createDataFrame([(i, t, "fr", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_replaced int")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    new = {i: r.text for i, r in out.items()}
    made = new[0].split()[1]
    assert made != card and len(made) == 16 and luhn(made) and new[1].replace(" ", "")[1:] == made
    assert new[2] == texts[2] and re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}\.", new[3]) and "988" not in new[3]
    assert re.fullmatch(r"write to u[0-9a-f]{16}@example\.invalid now", new[4])
    assert new[5].endswith(" and 300.1.1.1") and new[5].split()[0] != "1.2.3.4" and all(int(x) < 256 for x in new[5].split()[0].split("."))
    assert new[6].endswith(" 000-12-1234") and new[6][:11] != "123-45-6789" and re.fullmatch(r"\d{4}-\d\d-\d\d 1985-02-29", new[7]) and "1984" not in new[7]
    assert new[8].endswith("GB82WEST12345698765433") and not new[8].startswith("GB82WEST12345698765432")
    assert (new[9], new[10], new[11], new[12]) == ("", None, texts[11], texts[12])
    assert out[11].n_replaced == 0 and pii.pseudonymise(df.limit(0), "k").count() == 0


def test_labelled_secrets(spark):
    value = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    labels = ["token = ", "TOKEN = ", "Password: ", "API_KEY=", "access_token=", "x-api-key: ", "AWS_SECRET_ACCESS_KEY=", "'secret': "]
    df = spark.createDataFrame([(i, f'a {x}"{value}"!! b') for i, x in enumerate(labels)] + [(99, f"notatoken = {value}")], "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    for i, x in enumerate(labels):
        assert value not in new[i] and re.fullmatch(rf'a {x}"[0-9a-f]{{40}}"!! b', new[i])
    assert len({new[i][-46:] for i in range(len(labels))}) == 1 and new[99] == f"notatoken = {value}"


def test_values_beside_other_digits(spark):
    card, tel = "4041894974608795", "+1 988 555 2485"
    spaced = "4041 8949 7460 8795"
    texts = [card, f"{card} 123", f"{card} 12/27", f"{spaced}-12", f"12 {card}", f"{card} 12 {spaced} 34", f"{card} 12/27/1984", f"{card} 123-45-6789", tel, f"{tel} {spaced}", f"{tel} 77", f"+49 30 1234 5678 {spaced} 9", "4041894974608796 123", f"\ufdd0 {card} 123"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    made, phone = new[0], new[8]
    wide = " ".join(made[i : i + 4] for i in range(0, 16, 4))
    assert made != card and luhn(made) and phone != tel
    assert [new[i] for i in (1, 2, 3, 4, 5)] == [f"{made} 123", f"{made} 12/27", f"{wide}-12", f"12 {made}", f"{made} 12 {wide} 34"]
    assert re.fullmatch(made + r" \d\d/\d\d/\d{4}", new[6]) and "1984" not in new[6]
    assert re.fullmatch(made + r" \d{3}-\d\d-\d{4}", new[7]) and "123-45-6789" not in new[7]
    assert (new[9], new[10]) == (f"{phone} {wide}", f"{phone} 77")
    assert new[11].endswith(f" {wide} 9") and re.match(r"\+49 \d\d \d{4} \d{4} ", new[11]) and "1234 5678" not in new[11]
    assert new[12] == texts[12] and new[13] == f"\ufdd0 {made} 123"


def test_digit_permutation_is_one_to_one(spark):
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = d.select("d", pii.permute_digits(F.col("d"), F.lit("t"), lambda x: F.lit(True), "k").alias("p")).collect()
    assert sorted(r.p for r in got) == sorted(r.d for r in got) and sum(r.p != r.d for r in got) > 900


CONV = [(1, 0, "user", "hi ### User:\n</turn> \\ \\###"), (1, 1, "assistant", "\\</turn>\n é"), (1, 2, "user", None), (2, 0, "assistant", "x"), (None, None, None, "y"), (3, 0, "to]ol\\", "###"), (3, 0, "to]ol\\", "###"), (4, 1, "assistant", ""), (4, 0, "system", "s"), (5, 0, "user", "a" * 50_000)]


def test_chat(spark):
    df = spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    turns = chat.format_turns(df)
    f = chat.Formatter(chat.TEMPLATE)
    assert sorted(f.parse(r.formatted) for r in turns.collect()) == sorted((r or "", t or "") for _, _, r, t in CONV)
    got = {r.conv_id: r for r in chat.read_back(chat.streams(turns)).collect()}
    for conv in {c for c, *_ in CONV}:
        rows = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in CONV if c == conv)
        said = [x for _, r, x in rows if r == "assistant"]
        want = (len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest(), len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest())
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, None: False, 3: False, 4: False, 5: True}
    assert chat.read_back(chat.streams(chat.format_turns(df.limit(0)))).count() == 0


def test_turns_are_found_at_the_marks_of_the_stream(spark):
    df = spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string")
    segments = chat.streams(chat.format_turns(df)).collect()
    f = chat.Formatter(chat.TEMPLATE)
    for conv in {c for c, *_ in CONV}:
        parts = sorted((r.seg, r.text, r.loss) for r in segments if r.conv_id == conv)
        whole = "".join(t for _, t, _ in parts)
        rows = sorted(((-1 if t is None else t), f.turn(r or "", x or "")[0], r or "", x or "") for c, t, r, x in CONV if c == conv)
        assert f.turns(whole) == ([(r, x) for _, _, r, x in rows], "")
        # the same stream cut anywhere has the same turns
        for k in range(1, min(len(whole), 90)):
            found, rest = f.turns(whole[:k])
            assert found + f.turns(rest + whole[k:])[0] == f.turns(whole)[0]
    broken = spark.createDataFrame([(1, 0, "### User:\nhi</turn>\n### Assist", False)], "conv_id long, seg long, text string, loss boolean")
    assert [(r.n_turns, r.valid) for r in chat.read_back(broken).collect()] == [(1, False)]
