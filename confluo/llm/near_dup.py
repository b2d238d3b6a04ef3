"""Near-duplicate groups by HyperMinHash.

A document's set holds the distinct ``WIDTH``-word shingles of its text as 64-bit hashes. Its sketch spreads the
hashes over ``BUCKETS`` registers; a register keeps the leading-zero count and ten mantissa bits of its smallest
hash (16 bits together). An empty register borrows from a filled one in a fixed random order, so that short
documents are sketched alike. ``ROWS`` registers make a band. Two documents of similarity 0.75 share no band with a
probability of 5e-6 if their registers agree independently; the README has the measured loss, which is largest for sets of
a few shingles.

Steps: equal sets collapse into one node first (a group of copies costs one row). In each band bucket every node
is paired with the smallest one, never all with all. Pairs pass a collision-corrected Jaccard estimate from the
sketches (more than four standard deviations below the threshold; sets of up to ``SMALL`` shingles need not) and are then
confirmed on the full sets of the whole texts; links are contracted to components. Buckets that still hold several
components go on: their members are dealt to blocks, and those outside the most frequent component visit every block, some at
a time, where they are held against its members inside a task, by sketches and then on full sets. Only links leave it. So no partner is
dropped, no bucket is capped, and no group's pairs are written out. Keys of large buckets are salted in joins.

Defined results: a text without words (null, empty) has an empty set and no link; rows with a null doc_id take
part in no link, have a null component and are kept; repeated rows of a doc_id each get a row. Links are between doc_ids: ``dedup`` drops all rows of a doc_id
that is linked to a smaller one, and keeps one row of each set of shingles of a doc_id that stays. Other columns of
the input are ignored by ``groups`` and kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.graph import components
from .common import cut, ship, table, trim

WIDTH = 5
PERCENT = 75
ROWS, BANDS = 4, 32
BUCKETS = ROWS * BANDS
MARGIN = 0.16  # more than four standard deviations of the estimate at 0.75
SMALL = 64
BLOCK = 512  # members of a bucket in one task, and guests that it holds against them
HOT, HOT_KEYS = 1000, 100_000  # rows of a bucket that one task takes; more if there are more such buckets than that
BROADCAST_IDS = 1_000_000  # 8 MB, some 24 as a hash table; more ids are joined by a shuffle
BROADCAST_SKETCHES = 40_000  # 10 MB of 256 bytes each
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTORS = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)
ORDER = mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64)).reshape(BUCKETS, BUCKETS)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes; words end at ASCII blanks, A-Z is lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(width, len(w))
    n = len(w) - k + 1
    total = np.full(n, np.uint64(k))
    for j in range(k):
        total += h[j : j + n] * FACTORS[j]
    return np.unique(mix(total))


def sketch(h: np.ndarray) -> np.ndarray:
    """``BUCKETS`` registers of 16 bits."""
    bucket = ((h >> np.uint64(40)) * np.uint64(BUCKETS)) >> np.uint64(24)  # h is sorted, so this is too
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    low = np.minimum.reduceat(mix(h ^ MIX), at)
    part, power = np.frexp(low.astype(np.float64))
    reg = np.zeros(BUCKETS, np.uint16)
    full = bucket[at].astype(np.int64)
    reg[full] = ((64 - power).clip(0, 63).astype(np.uint16) << 10) | ((part - 0.5) * 2048).clip(0, 1023).astype(np.uint16)
    if len(full) < BUCKETS:
        gap = np.setdiff1d(np.arange(BUCKETS), full, assume_unique=True)
        reg[gap] = reg[full[ORDER[np.ix_(gap, full)].argmin(axis=1)]]
    return reg


def bands(regs: np.ndarray) -> np.ndarray:
    """Band keys (documents x BANDS) of sketches (documents x BUCKETS)."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    return mix((r * FACTORS[:ROWS]).sum(axis=2, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of sketch pairs, corrected for registers that agree by chance.

    Two unrelated registers agree if the leading-zero counts (probability sum of 4^-i, 1/3) and the ten
    mantissa bits agree.
    """
    chance = 1 / 3 / 1024
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def able(e: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs with these estimates and sizes can be links: sizes alone can rule it out, and small sets are
    confirmed whatever the estimate."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * low >= PERCENT * high) & ((e >= PERCENT / 100 - MARGIN) | (high <= SMALL))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, fp (fingerprint of the set), regs and text_hash of each row; null fp and regs for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, regs = [], [], []
            for t in b["text"]:
                h = shingles(t.as_py())
                n.append(len(h))
                fp.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                regs.append(sketch(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary()), b["text_hash"]], ["doc_id", "n", "fp", "regs", "text_hash"])
        trim()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, n long, fp binary, regs binary, text_hash long")


def band_rows(nodes: DataFrame) -> DataFrame:
    """(key, id) of every band of nodes (id, regs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = bands(_registers(b["regs"])).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b["id"].to_numpy(), BANDS))], ["key", "id"])
        trim()

    return nodes.select("id", "regs").mapInArrow(run, "key long, id long")


def _among(df: DataFrame, ids: DataFrame, on: str) -> tuple[int, DataFrame]:
    """How many ``ids`` (id, distinct) there are, and the rows of ``df`` whose column ``on`` is one of them; the ids are
    broadcast up to a checked number."""
    ids = cut(ids.select(F.col("id").alias(on)), "ids")
    n = ids.count()
    return n, df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, on, "left_semi")


def _both(pairs: DataFrame, df: DataFrame, columns: list[str], small: bool) -> DataFrame:
    """``pairs`` with ``columns`` of their a and b, as <first letter>a and <first letter>b."""
    for k in "ba":
        side = df.select(F.col("id").alias(k), *[F.col(c).alias(c[0] + k) for c in columns])
        pairs = pairs.join(F.broadcast(side) if small else side, k)
    return pairs


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = able(estimate(_registers(b["ra"]), _registers(b["rb"])), b["na"].to_numpy(), b["nb"].to_numpy())
                yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in batches:
            ok = []
            for i, ta, tb in zip(b["a"].to_pylist(), b["ta"], b["tb"], strict=True):
                if i != last or left is None:
                    last, left = i, shingles(ta.as_py())
                right = shingles(tb.as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
        trim()

    def ids(p: DataFrame) -> DataFrame:
        return p.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    n, regs = _among(nodes.select("id", "regs", "n"), ids(pairs), "id")
    small = n <= BROADCAST_SKETCHES
    regs = regs if small else cut(regs, "regs")
    pairs = cut(_both(pairs, regs, ["regs", "n"], small).select("a", "b", "ra", "rb", "na", "nb").mapInArrow(likely, "a long, b long"), "likely")
    if pairs.isEmpty():
        return pairs
    texts = cut(_among(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids(pairs), "id")[1], "texts")
    # sorted by a: the set of a is made once for a run of pairs
    both = _both(pairs, texts, ["text"], False)
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long"), "links")


def _bucketed(buckets: DataFrame, full: DataFrame, key: str = "key") -> DataFrame:
    """``buckets`` (``key``, id, ...) with the columns of ``full`` (``key``, size, ...; kept in storage) of their key; a key of many
    rows is spread by a salt, the hash of id. Such keys are few: at most ``HOT_KEYS``, as larger ones count as hot if there
    are more."""
    hot_at = max(HOT, (full.agg(F.sum("size")).first()[0] or 0) // HOT_KEYS)
    splits = F.ceil(F.col("size") / hot_at).cast("int")
    hot = full.where(F.col("size") > hot_at).select(key, splits.alias("splits"))
    salted = buckets.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("splits", F.lit(1))).cast("int")).drop("splits")
    return salted.join(full.withColumn("salt", F.explode(F.sequence(F.lit(0), splits - 1))), [key, "salt"]).drop("salt")


def _opened(held: DataFrame, label: DataFrame) -> DataFrame:
    """(key, id, label, size, major, others) of the buckets that hold several components; major is the most frequent of them, and
    others counts the members outside it."""
    named = cut(held.select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")), "named")
    each = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_ = each.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top")).where("size > top.n")
    open_ = open_.select("key", "size", F.col("top.label").alias("major"), (F.col("size") - F.col("top.n")).alias("others"))
    return cut(_bucketed(named, cut(open_, "major")), "open")


def _across(held: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between different components inside buckets, found without writing pairs out.

    A bucket's members are dealt to blocks of about ``BLOCK``, each to one. Those outside the most frequent component are guests
    of all blocks, in groups of about ``BLOCK``; a task has the members of a block and one group of guests. It holds the
    guests against the members by their sketches; likely partners are confirmed on the full sets, the likeliest first, until
    one links to each component. A pair that shares several bands is looked at in the first.
    """
    ids = held.select("id").distinct()
    members = _among(nodes.select("id", "regs", "n"), ids, "id")[1]
    members = members.join(_among(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, "id")[1], "id")
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    dealt = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "id"), count(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    rare = (F.col("label") != F.col("major")).alias("rare")
    home = held.select("key", "id", "label", rare, F.lit(False).alias("guest"), dealt(0, "size").alias("x"), each("others").alias("y"))
    guests = held.where("label <> major").select("key", "id", "label", rare, F.lit(True).alias("guest"), each("size").alias("x"), dealt(1, "others").alias("y"))
    rows = home.union(guests).join(members, "id")

    def links(key: int, t: pa.Table) -> Iterator[tuple[int, int]]:
        guest, ids, labels, rare, n, regs, texts = (*(t[c].to_numpy() for c in ("guest", "id", "label", "rare", "n")), _registers(t["regs"]), t["text"])
        keys = bands(regs)
        here = int((keys == key).all(axis=0).argmax())
        home = np.flatnonzero(~guest)
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(texts[i].as_py())
            return sets[i]

        for i in np.flatnonzero(guest) if len(home) else []:
            e = estimate(regs[home], regs[i])
            likely = (labels[home] != labels[i]) & able(e, n[home], n[i]) & ((keys[home] == keys[i]).argmax(axis=1) == here)
            likely &= ~rare[home] | (ids[home] > ids[i])  # two that are guests of each other are compared once
            done: set[int] = set()
            for j in home[likely][np.argsort(-e[likely], kind="stable")]:
                if labels[j] not in done:
                    both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                    if 100 * both >= PERCENT * (len(of(i)) + len(of(j)) - both):
                        done.add(labels[j])
                        yield int(ids[i]), int(ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept)
            found = list(links(int(now[0]), t))
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                key = np.stack([batch[c].to_numpy() for c in ("key", "x", "y")])
                cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    if kept and tuple(key[:, s]) != now:
                        yield close()
                        kept = []
                    now = tuple(key[:, s])
                    kept.append(batch.slice(s, e - s))
        if kept:
            yield close()
        trim()

    tasks = rows.select("key", "x", "y", "id", "label", "rare", "guest", "n", "regs", "text").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return cut(tasks.mapInArrow(run, "a long, b long"), "across")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept of each row."""
    return _grouped(docs).drop("fp", "text_hash")


def _grouped(docs: DataFrame) -> DataFrame:
    """``groups``, with fp and text_hash."""
    rows = cut(sketches(docs), "sketches")
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    # One node per distinct set, named by its smallest doc_id.
    nodes = cut(some.groupBy("fp").agg(F.min(F.struct("doc_id", "regs", "n")).alias("s"), F.count("*").alias("size")).select(F.col("s.doc_id").alias("id"), "fp", "s.regs", "s.n", "size"), "nodes")
    buckets = band_rows(nodes)
    full = cut(buckets.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1"), "full")
    held = cut(_bucketed(buckets, full), "buckets")
    star = cut(held.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "star")
    label = cut(components(_verify(star, nodes, docs)), "labels")
    held = _opened(held.where("size > 2"), label)
    if not held.isEmpty():
        label = cut(components(label.select(F.col("id").alias("a"), F.col("label").alias("b")).union(_across(held, nodes, docs))), "labels")
    named = cut(nodes.select("fp", "id", "size").join(label, "id", "left").select("fp", "size", F.coalesce("label", "id").alias("label")), "named")
    rows = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"), "text_hash")
    linked = _bucketed(rows.where("fp IS NOT NULL").withColumn("id", F.monotonically_increasing_id()), named, "fp").drop("id", "size")
    out = linked.unionByName(rows.where("fp IS NULL").withColumn("label", F.lit(None).cast("long")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"), "fp", "text_hash")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest doc_id. Of rows that repeat a kept doc_id,
    one of each set of shingles stays."""
    kept = _grouped(docs).where("kept AND doc_id IS NOT NULL")
    keep = kept.groupBy("doc_id", "fp").agg(F.min("text_hash").alias("__h")).select("doc_id", "__h")
    one = docs.withColumn("__h", F.xxhash64("text")).join(keep, ["doc_id", "__h"], "left_semi").dropDuplicates(["doc_id", "__h"]).drop("__h")
    return one.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


ship(__name__)
ship(graph.__name__)


def op6_near_dup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


SQL = {
    "op6_near_dup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON d.doc_id = a"""
}
