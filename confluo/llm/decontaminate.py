"""Benchmark decontamination: a hash set of the test windows, and a scan of the training windows.

Texts are lower-cased (A-Z) and cut into words. A window is ``n`` consecutive words of a benchmark item; an
item with fewer words, but not none, is one window. The set of windows (hash and words) is joined with the
windows of the documents; equal hashes are verified word by word; the words that an occurrence covers are hit.

Native: only DataFrame functions. Every test window has an anchor, its longest word. Only document windows
that hold an anchor can be in the set, so no others are hashed. The anchors sit in a constant hash set up to
``MAX_ANCHORS`` of them; beyond that every document window is made. The window set is broadcast up to
``BROADCAST_WINDOWS`` windows and else joined by a shuffle. Results are the same either way.

Defined results: a null or empty text has no words and no hits; its items_sha256 is that of ''. Repeated rows
each get a row. A null item_id counts as ''; rows of one item_id count as one item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut, table

MAX_ANCHORS = 50_000
BROADCAST_WINDOWS = 500_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # in a text that is not lower-cased


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), GAP), "")


def windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The window set: gram array<string>, size, hash, anchor, items array<string>."""
    size = F.least(F.size("w"), F.lit(n))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    longest = F.array_max(F.transform("gram", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))
    return (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(grams).alias("gram"))
        .groupBy("gram")
        .agg(F.collect_set("item").alias("items"))
        .select("gram", "items", F.size("gram").alias("size"), F.xxhash64("gram").alias("hash"), longest["w"].alias("anchor"))
    )


def _starts(w: Column, at: Column | None, n: int) -> Column:
    """Starts of the windows of ``n`` words that hold one of the positions ``at``, or of all of them."""
    last = F.size(w) - n
    if at is None:
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
    else:

        def near(p: Column) -> Column:
            first = F.greatest(p - (n - 1), F.lit(0))
            return F.when(last >= first, F.sequence(first, F.greatest(F.least(p, last), first)))

        starts = F.array_distinct(F.flatten(F.filter(F.transform(at, near), lambda x: x.isNotNull())))
    return F.coalesce(starts, F.array().cast("array<int>"))


def _spans(w: Column, at: Column | None, sizes: list[int]) -> Column:
    def sized(n: int) -> Column:
        return F.transform(_starts(w, at, n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("size")))

    return F.concat(*map(sized, sizes)) if sizes else F.array().cast("array<struct<start:int,size:int>>")


def occurrences(docs: DataFrame, benchmark: DataFrame, n: int = 13, keep: list[str] | None = None) -> DataFrame:
    """One row per document row: the columns ``keep``, n_words, spans (start, end in words) and items.

    ``docs`` needs a ``text`` column. Rows are told apart by an id of their own, so repeated rows stay.
    """
    keep = keep or ["doc_id"]
    tests = cut(windows(benchmark, n), "windows")
    count = tests.count()
    sizes = sorted(r[0] for r in tests.select("size").distinct().collect())  # n values at most
    anchors = [r[0] for r in tests.select("anchor").distinct().limit(MAX_ANCHORS + 1).collect()]
    tests = F.broadcast(tests) if count <= BROADCAST_WINDOWS else tests
    w = F.col("__w")
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], words(F.col("text")).alias("__w"))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    at = None
    if len(anchors) <= MAX_ANCHORS:
        marks = F.transform(w, lambda x, i: F.when(x.isin(anchors or [""]), i).otherwise(F.lit(-1)))
        rows, at = rows.withColumn("__at", F.array_remove(marks, -1)), F.col("__at")
    grams = F.transform(_spans(w, at, sizes), lambda s: F.struct(s["start"].alias("start"), F.slice(w, s["start"] + 1, s["size"]).alias("gram")))
    keys = [f"__k{i}" for i in range(len(keep))]
    found = (
        rows.select(*keys, "__row", F.size(w).alias("n_words"), F.explode_outer(grams).alias("__g"))
        .select(*keys, "__row", "n_words", F.col("__g.start").alias("start"), F.col("__g.gram").alias("gram"), F.xxhash64("__g.gram").alias("hash"))
        .join(tests.select("hash", F.col("gram").alias("test"), "items"), "hash", "left")
    )
    hit = F.col("gram") == F.col("test")
    return (
        found.groupBy("__row", *keys, "n_words")
        .agg(
            F.collect_set(F.when(hit, F.struct("start", (F.col("start") + F.size("gram")).alias("end")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
        )
        .select(*[F.col(k).alias(c) for k, c in zip(keys, keep, strict=True)], F.col("n_words").cast("long").alias("n_words"), F.array_sort("spans").alias("spans"), "items")
    )


def covered(spans: Column) -> Column:
    """How many words sorted spans cover together."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("to"))
    add = lambda a, s: F.struct(
        (a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("sum"), F.greatest(a["to"], s["end"]).alias("to")
    )
    return F.aggregate(spans, zero, add, lambda a: a["sum"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Per document row: n_words, n_hit, items and whether hits reach 1/share of the words."""
    out = occurrences(docs, benchmark, n, keep).withColumn("n_hit", covered(F.col("spans")).cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = report(docs, benchmark, n, share).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")


def _kept(spans: Column, n: Column) -> Column:
    """The ranges (start, size) of ``n`` words that sorted ``spans`` leave."""
    zero = F.struct(F.array().cast("array<struct<start:int,size:int>>").alias("kept"), F.lit(0).alias("to"))
    gap = lambda a, to: F.when(to > a["to"], F.array(F.struct(a["to"].alias("start"), (to - a["to"]).alias("size")))).otherwise(F.slice(a["kept"], 1, 0))
    add = lambda a, s: F.struct(F.concat(a["kept"], gap(a, s["start"])).alias("kept"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, zero, add, lambda a: F.concat(a["kept"], gap(a, n)))


def _without(parts: Column, spans: Column, glue: str) -> Column:
    """``parts`` joined by ``glue``, without those that sorted ``spans`` cover. Each is looked at once."""
    held = F.array(F.struct(parts.alias("parts"), spans.alias("spans")))  # so that lambdas don't make them again and again
    kept = lambda x: F.transform(_kept(x["spans"], F.size(x["parts"])), lambda r: F.array_join(F.slice(x["parts"], r["start"] + 1, r["size"]), glue))
    return F.transform(held, lambda x: F.array_join(kept(x), glue))[0]


def _with_hits(docs: DataFrame, benchmark: DataFrame, n: int, share: int) -> DataFrame:
    """``docs`` with a column __hit: struct(spans, contaminated), null where nothing is hit. Rows of one doc_id are told
    apart by a hash of their texts, so no text is carried through the search."""
    key = F.xxhash64("text")
    hits = report(docs.withColumn("__h", key), benchmark, n, share, ["doc_id", "__h"]).where("n_hit > 0")
    hits = hits.select(F.col("doc_id").alias("__i"), F.col("__h").alias("__t"), "spans", "contaminated").distinct()
    hits = hits.select("__i", "__t", F.struct("spans", "contaminated").alias("__hit"))
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("__i")) & (key == F.col("__t")), "left")


def _replaced(out: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    text = F.when(F.col("__hit").isNull(), F.col("text")).otherwise(text)
    return out.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def drop_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The documents with hit words taken out: ``text`` becomes the remaining words joined by spaces where
    there was a hit and stays as it is elsewhere."""
    return _replaced(_with_hits(docs, benchmark, n, 1), docs, _without(words(F.col("text")), F.col("__hit.spans"), " "))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """The rows that are not contaminated, with all their columns; hit words, and what stands between a hit word and the
    next word, are taken out of their ``text``. The rest of the text is not changed; words around a cut are not scanned anew."""
    out = _with_hits(docs, benchmark, n, share).where(F.col("__hit").isNull() | ~F.col("__hit.contaminated"))
    gaps = F.split("text", WORD, -1)
    parts = F.zip_with(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.slice(gaps, F.lit(2), F.size(gaps)), lambda w, g: F.concat(w, F.coalesce(g, F.lit(""))))
    return _replaced(out, docs, F.concat(F.get(gaps, F.lit(0)), _without(parts, F.col("__hit.spans"), "")))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (UPPER, LOWER)
SQL = {
    "op10_decontaminate": f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, w[i:i + least(len(w), 13) - 1] AS gram FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(gram) AS n FROM grams),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes),
occ AS (SELECT DISTINCT r, i, n, item FROM (SELECT r, i, n, w[i:i + n - 1] AS gram FROM p) JOIN grams USING (gram)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
}
