"""Token ids in patched frame-of-reference blocks.

Format: a Parquet table of segments, written by Spark's committer (so a lost executor's task is simply run
again, on any storage that Spark knows). A row holds whole documents in ascending doc_id order:

    shard, seg        order of the segments: shard is the range partition, seg counts within it
    shard_offset      ids of the shard before this segment
    doc_ids, doc_sizes
    starts   binary   the block index: little-endian u32 offset of each block in ``payload``
    payload  binary   blocks of 128 ids: u32 minimum | u8 width | u8 ids in the block | u8 exceptions | 16 * width
                      bytes of packed (id - minimum) | u8 positions and u32 values of the exceptions

A block's width is that of its 90th percentile after the minimum is taken off; larger values are exceptions.

Defined results: a null text is encoded as an empty one (one end id); repeated rows each keep their ids; rows
of one doc_id go by a hash of their texts, then by the texts; a null doc_id sorts first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import groups, scratch, ship, table, trim, worker_cache

BLOCK = 128
HEAD = 7
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 16
KEPT = 400_000  # tokens of the pre-tokenizer that a worker keeps; texts repeat words, so few reach the tokenizer
WORDS = 4  # eight bytes each: the longest token that is kept
JOINED = 256
#: Pre-tokenization of byte-level vocabularies, done on the bytes of many texts together: runs of letters, of digits and
#: of other signs, with a space before them; blanks before the last of a run of blanks; and these endings.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
SIGN, LETTER, DIGIT, SPACE, BLANK, OTHER = range(6)
#: Where two libraries could differ about blanks, the whole text is left to the tokenizer.
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
LONG = 1 << 20  # characters; longer texts are cut up in pieces
BEFORE_SPACE = re.compile(r"[^ \t\r\n](?= )")
WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of ASCII bytes, and of the second byte after C2 and C3; what Unicode versions could doubt is OTHER."""
    one = np.full(256, SIGN, np.int8)
    one[[b for b in range(128) if chr(b).isalpha()]] = LETTER
    one[48:58], one[32], one[[9, 10, 13]], one[128:] = DIGIT, SPACE, BLANK, OTHER
    c2, c3 = np.full(256, OTHER, np.int8), np.full(256, OTHER, np.int8)
    for b in range(0x80, 0xC0):
        c3[b] = LETTER if chr(b + 0x40).isalpha() else SIGN
        c2[b] = OTHER if chr(b).isalnum() or chr(b).isnumeric() or b < 0xA1 or b == 0xAD else SIGN
    return one, c2, c3


ONE, AFTER_C2, AFTER_C3 = _classes()
MASKS = np.asarray([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
FACTORS = np.asarray([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def starts_of_tokens(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the tokens of the pre-tokenizer start in the bytes of texts, which start at ``texts``. A run without blanks
    that holds an OTHER character is one piece, for the tokenizer to cut up."""
    n = len(raw)
    kind = ONE[raw]
    for lead, after in ((0xC2, AFTER_C2), (0xC3, AFTER_C3)):
        at = np.flatnonzero(raw == lead)
        kind[at] = kind[at + 1] = after[raw[at + 1]]
    first = np.zeros(n + 4, bool)
    first[texts] = True
    first[n:] = True
    blank = (kind == SPACE) | (kind == BLANK)
    if (kind == OTHER).any():
        run = np.cumsum((~blank) & (np.append(True, blank[:-1]) | first[:n]))
        other = np.zeros(run[-1] + 1, bool)
        other[run[kind == OTHER]] = True
        kind[other[run] & ~blank] = OTHER
    before, blank_before = np.append(np.int8(-1), kind[:-1]), np.append(False, blank[:-1])
    starts = first[:n] | (blank != blank_before) | (~blank & (kind != before))
    starts &= first[:n] | blank | (before != SPACE)  # a space goes with what is after it
    last = blank & ~np.append(blank[1:], True) & ~first[1 : n + 1]  # the last blank before something else
    starts |= last
    mark = np.flatnonzero((raw == 0x27) & (kind == SIGN) & starts)
    mark = mark[~first[mark + 1]]
    mark = mark[kind[mark + 1] == LETTER]
    wide = np.append(raw, np.zeros(4, np.uint8))
    for ending in ENDINGS:
        fit = mark
        for k, c in enumerate(ending.encode(), 1):
            fit = fit[(wide[fit + k] == c) & ~first[fit + k]]
        starts[fit + 1] = False
        after = fit + 1 + len(ending)
        starts[after[after < n]] = True
    return np.flatnonzero(starts)


class Tokens:
    """Numbers of byte strings of up to 8 * ``WORDS`` bytes: a hash table in arrays, exact on all bytes."""

    def __init__(self, bits: int):
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.empty((0, WORDS), np.uint64)
        self.n = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys * FACTORS).sum(axis=1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(32))) * FACTORS[1]
        return ((h ^ (h >> np.uint64(29))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        at = np.arange(len(keys))
        while len(at):
            n = self.slots[slot[at]]
            at, n = at[n >= 0], n[n >= 0]
            same = (self.keys[n] == keys[at]).all(axis=1)
            out[at[same]] = n[same]
            at = at[~same]
            slot[at] = (slot[at] + 1) & (len(self.slots) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Give new, distinct keys the next numbers."""
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        if number.size and number[-1] >= len(self.keys):
            more = np.empty((max(2 * len(self.keys), self.n + len(keys)), WORDS), np.uint64)
            more[: self.n] = self.keys[: self.n]
            self.keys = more
        self.keys[number] = keys
        self.n += len(keys)
        slot = self._slot(keys)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            lost = self.slots[slot] != number
            number, slot = number[lost], (slot[lost] + 1) & (len(self.slots) - 1)


class Encoder:
    """Encoder over one tokenizer file that keeps tokens; equal to ``encode(text, add_special_tokens=False)``.

    The ids of token n are ``ids[at[n] : at[n + 1]]``; a text's ids are gathered from there. Beyond ``kept`` tokens the half
    that the most batches used stays. A file of another kind is left to the tokenizer, text by text.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.kept, self.bits = kept, max(4, (8 * kept).bit_length() - 1)
        tokens = self.t.get_added_tokens_decoder()
        self.added = [t.content for t in tokens.values()]
        # An added token keeps what stands beside it apart, so tokens are encoded many at a time.
        self.bar = next(((i, t.content) for i, t in sorted(tokens.items()) if not (t.lstrip or t.rstrip or t.single_word)), None)
        kind = __import__("json").loads(self.t.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_bytes = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and kind.get("normalizer") is None
        self.known = Tokens(self.bits)
        self.ids, self.at, self.uses = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int32)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after the other, and how many each token has, of tokens that are a space and letters: one word each."""
        found = self.t.encode_batch(["".join(tokens[i : i + JOINED]) for i in range(0, len(tokens), JOINED)], add_special_tokens=False)
        size = [np.bincount(e.word_ids, minlength=min(JOINED, len(tokens) - i * JOINED)) for i, e in enumerate(found)]
        return np.concatenate([np.asarray(e.ids, np.uint32) for e in found]), np.concatenate(size)

    def _others(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.bar is None:
            found = self._batch(tokens)
            return np.concatenate(found), np.asarray([len(x) for x in found])
        flat = np.concatenate(self._batch([self.bar[1].join(tokens[i : i + JOINED]) + self.bar[1] for i in range(0, len(tokens), JOINED)]))
        bars = flat == self.bar[0]
        return flat[~bars], np.diff(np.flatnonzero(bars), prepend=-1) - 1

    def _add(self, tokens: list[str]) -> None:
        """The ids of new tokens, which have the next numbers."""
        plain = np.fromiter((WORD.fullmatch(t) is not None for t in tokens), bool, len(tokens))
        size, old = np.empty(len(tokens), np.int64), len(self.ids)
        found = [(np.flatnonzero(mask), encode) for mask, encode in ((plain, self._words), (~plain, self._others)) if mask.any()]
        found = [(at, *encode([tokens[i] for i in at.tolist()])) for at, encode in found]
        for at, _, n in found:
            size[at] = n
        ends = old + np.cumsum(size)
        self.ids = np.concatenate([self.ids, np.empty(int(size.sum()), np.uint32)])
        for at, ids, n in found:
            self.ids[np.repeat(ends[at] - np.cumsum(n), n) + np.arange(len(ids))] = ids
        self.at = np.concatenate([self.at, ends])
        self.uses = np.concatenate([self.uses, np.zeros(len(tokens), np.int32)])

    def _keep(self, n: np.ndarray) -> None:
        """Keep the tokens ``n`` only."""
        keys = self.known.keys[n]
        self.known = Tokens(self.bits)
        self.known.add(keys)
        self.ids, size = self._gather(n)
        self.at, self.uses = np.concatenate([[0], np.cumsum(size)]), self.uses[n] >> 1

    def _gather(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the tokens numbered ``n``, one after the other, and how many each has."""
        size = self.at[n + 1] - self.at[n]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.at[n] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that the pre-tokenization on bytes understands."""
        sizes = np.asarray([len(t) for t in texts], np.int64)
        data = b"".join(texts)
        if not data:
            return [np.empty(0, np.uint32) for _ in texts]
        raw = np.frombuffer(data + bytes(8 * WORDS), np.uint8)
        first = np.cumsum(sizes) - sizes
        starts = starts_of_tokens(raw[: len(data)], first[sizes > 0])
        length = np.diff(np.append(starts, len(data)))
        if self.known.n > self.kept:
            self._keep(np.sort(np.argsort(-self.uses[: self.known.n], kind="stable")[: self.kept // 2]))
        window = np.ndarray((len(data) + 8 * (WORDS - 1),), "<u8", raw, 0, (1,))
        keys = np.zeros((len(starts), WORDS), np.uint64)
        for k in range(WORDS):
            some = np.flatnonzero(length > 8 * k) if k else slice(None)
            keys[some, k] = window[starts[some] + 8 * k] & MASKS[(length[some] - 8 * k).clip(max=8)]
        # a key's bytes and its length are one to one, as 0 bytes at the end would be the only way to clash
        short = (length <= 8 * WORDS) & (raw[starts + length - 1] != 0)
        n = np.full(len(starts), -1, np.int64)
        n[short] = self.known.find(keys[short])
        miss = np.flatnonzero(n < 0)
        own = self.known.n
        if len(miss):
            miss = miss[np.argsort(~short[miss], kind="stable")]  # those to keep come first
            number: dict[bytes, int] = {}
            n[miss] = [number.setdefault(data[s:e], own + len(number)) for s, e in zip(starts[miss].tolist(), (starts[miss] + length[miss]).tolist(), strict=True)]
            fresh = miss[np.unique(n[miss], return_index=True)[1]]
            self._add([t.decode() for t in number])
            self.known.add(keys[fresh[short[fresh]]])
        used = np.zeros(len(self.uses), bool)
        used[n] = True
        self.uses += used
        flat, size = self._gather(n)
        before = np.append(0, np.cumsum(size))
        ends = before[np.searchsorted(starts, first + sizes, side="left")]
        if len(self.uses) > self.known.n:  # what is not to be kept
            self.ids, self.at, self.uses = self.ids[: self.at[self.known.n]], self.at[: self.known.n + 1], self.uses[: self.known.n]
        return np.split(flat, ends[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """u32 ids of each text."""
        odd = [not self.by_bytes or ODD.search(t) is not None or any(a in t for a in self.added) for t in texts]
        some = iter(self._together([t.encode() for t, o in zip(texts, odd, strict=True) if not o and len(t) <= LONG]))
        whole = iter(self._batch([t for t, o in zip(texts, odd, strict=True) if o]))
        return [next(whole) if o else next(some) if len(t) <= LONG else np.concatenate([self._together([x.encode()])[0] for x in pieces(t)]) for t, o in zip(texts, odd, strict=True)]


def pieces(text: str) -> Iterator[str]:
    """A long text, cut where a space follows something else; tokens never span that."""
    at = 0
    while at < len(text):
        cut = BEFORE_SPACE.search(text, at + LONG)
        to = cut.end() if cut else len(text)
        yield text[at:to]
        at = to


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and block index of u32 ids."""
    n = len(ids)
    if not n:
        return b"", b""
    blocks = -(-n // BLOCK)
    v = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], ids.dtype)]).reshape(blocks, BLOCK).astype(np.int64)
    low = v.min(axis=1)
    v -= low[:, None]
    width = np.frexp(np.partition(v, int(BLOCK * PERCENTILE), axis=1)[:, int(BLOCK * PERCENTILE)].astype(np.float64))[1].astype(np.int64)
    out_of = v >= (np.int64(1) << width)[:, None]
    n_ids = np.full(blocks, BLOCK, np.int64)
    n_ids[-1] = n - (blocks - 1) * BLOCK
    exc = out_of.sum(axis=1)
    sizes = HEAD + BLOCK // 8 * width + 5 * exc
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(ends[-1], np.uint8)
    head = np.empty((blocks, HEAD), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(blocks, 4)
    head[:, 4], head[:, 5], head[:, 6] = width, n_ids, exc
    out[starts[:, None] + np.arange(HEAD)] = head
    small = np.where(out_of, 0, v)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        out[starts[rows, None] + HEAD + np.arange(BLOCK // 8 * w)] = _pack(small[rows], int(w))
    b, pos = np.nonzero(out_of)
    if len(b):
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        at = starts[b] + HEAD + BLOCK // 8 * width[b]
        out[at + rank] = pos
        out[(at + exc[b] + 4 * rank)[:, None] + np.arange(4)] = v[b, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype("<u4").tobytes()


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of BLOCK numbers below 2**w as little-endian bits; eight of them make w bytes."""
    eight = v.astype(np.uint64).reshape(-1, 8)
    words = np.zeros((len(eight), 5), np.uint64)  # the last takes what is shifted out, which is nothing
    for k in range(8):
        word, shift = divmod(k * w, 64)
        words[:, word] |= eight[:, k] << np.uint64(shift)
        if shift + w > 64:
            words[:, word + 1] |= eight[:, k] >> np.uint64(64 - shift)
    return words.view(np.uint8).reshape(len(eight), 40)[:, :w].reshape(len(v), BLOCK // 8 * w)


def _windows(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    return np.ndarray((len(raw),), "<u8", padded, 0, (1,))


def unpack(payload: bytes, index: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first..last (all by default); only those blocks are read."""
    raw, starts = np.frombuffer(payload, np.uint8), np.frombuffer(index, "<u4").astype(np.int64)[first:last]
    if not len(starts):
        return np.empty(0, np.uint32)
    head = raw[starts[:, None] + np.arange(HEAD)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.int64)
    width, n_ids, exc = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64), head[:, 6].astype(np.int64)
    v = np.zeros((len(starts), BLOCK), np.int64)
    # every eight bytes of the payload as a number, at any byte
    window = _windows(raw)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bit = np.arange(BLOCK) * w
        v[rows] = (window[(starts[rows] + HEAD)[:, None] + (bit >> 3)] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << int(w)) - 1)
    b = np.repeat(np.arange(len(starts)), exc)
    if len(b):
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        at = starts[b] + HEAD + BLOCK // 8 * width[b]
        big = np.ascontiguousarray(raw[(at + exc[b] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        v[b, raw[at + rank]] = big
    v += low[:, None]
    return v[np.arange(BLOCK) < n_ids[:, None]].astype(np.uint32)


SEGMENTS = "shard int, seg int, shard_offset long, n_tokens long, doc_ids array<long>, doc_sizes array<long>, starts binary, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every whole text of (doc_id, text), append ``end_id``, and write segments in ascending doc_id order.

    The texts are dealt to ranges of doc_id before they are encoded: each is encoded once, and only texts, not ids,
    are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would hold memory of its own
        encoder = worker_cache(("encoder", tokenizer), lambda: Encoder(tokenizer))
        end = np.asarray([end_id], np.uint32)
        shard, seg, offset = TaskContext.get().partitionId(), 0, 0
        docs, parts, held = [], [], 0

        def close() -> pa.RecordBatch:
            payload, starts = pack(np.concatenate([x for p in parts for x in (p, end)]))
            cols = [([shard], pa.int32()), ([seg], pa.int32()), ([offset], pa.int64()), ([held], pa.int64()), ([docs], pa.list_(pa.int64())), ([[len(p) + 1 for p in parts]], pa.list_(pa.int64())), ([starts], pa.binary()), ([payload], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], [c.split()[0] for c in SEGMENTS.split(", ")])

        for part in groups(batches, "text", size=2 << 20):
            for doc, ids in zip(part["doc_id"].to_pylist(), encoder.encode([t or "" for t in part["text"].to_pylist()]), strict=True):
                docs.append(doc)
                parts.append(ids)
                held += len(ids) + 1
                if held >= SEGMENT_IDS:
                    yield close()
                    seg, offset = seg + 1, offset + held
                    docs, parts, held = [], [], 0
        if docs:
            yield close()
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")  # many rows of one doc_id are parted
    dealt.select("doc_id", "text").mapInArrow(run, SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and ids (u32, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(r["payload"], r["starts"]).astype("<u4")
                ends = np.cumsum(np.asarray(r["doc_sizes"], np.int64))
                begins = ends - np.asarray(r["doc_sizes"], np.int64)
                raw = [ids[s:e].tobytes() for s, e in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["base"] + r["shard_offset"], pa.int64()), pa.array(ends - begins, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    segments = spark.read.schema(SEGMENTS).parquet(path)
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per shard
    base = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", before.alias("base"))
    # A row per range partition, so this is as small as the number of tasks that wrote.
    return segments.join(F.broadcast(base), "shard").drop("shard", "seg").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


ship(__name__)


def op3_token_blocks(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
