"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors become integers floor(scale * x). They are dealt to shards of a bounded number of rows. A shard's index
holds, per component, the postings (row, value) in segments of falling quantised impact |value| >> SHIFT. For a
query, the segments of all components are processed in order of falling |query value| * quantised impact, adding
to the rows' scores. Rows without a posting in the processed part of a component can still gain at most
|query value| * (the next segment's largest impact) from it; the sum of these over the components bounds what any
score can still change. Processing stops only on the proof that the rows whose upper bound reaches the k-th best lower
bound are few; these possible members are rescored exactly. Without a proof every segment is processed and the
scores are exact.

Queries are packed in blocks, each block meets each shard once (a stated query set against all rows, in blocks),
and a shard returns its k best per query; a window merges those lists.

Defined results: a vector that is null or holds a null or non-finite component takes part in nothing; repeated rows of
an id are candidates each; queries of one id with the same vector are one query, with other vectors one each, with ranks
of its own; a query never gets rows of its own id; ties go to the smaller id; vectors of another length than the query
count as padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, ship, table, trim

SCALE = 1024
SHARD_ROWS = 8192
QUERY_ROWS = 256
SHIFT = 6
FEW = 8  # stop when at most FEW * k rows can still be members
ROUNDS = 24  # bounds are looked at after each 1/ROUNDS of the postings


class Shard:
    """Impact-ordered index of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, d = x.shape
        q = np.abs(x) >> SHIFT
        order = np.argsort(-q, axis=0, kind="stable")  # per component, rows by falling quantised impact
        self.seg: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # component, largest impact, rows, values
        self.ceil = np.zeros(d, np.int64)
        comp, top = [], []
        for j in range(d):
            o = order[:, j]
            level = q[o, j]
            cuts = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
            for s, e in zip(cuts, [*cuts[1:], n], strict=True):
                if level[s] or np.any(x[o[s:e], j]):
                    self.seg.append((j, int(((level[s] + 1) << SHIFT) - 1), o[s:e], x[o[s:e], j]))
                    comp.append(j)
                    top.append(self.seg[-1][1])
        self.comp, self.top = np.asarray(comp, np.int64), np.asarray(top, np.int64)
        self.size = np.asarray([len(s[2]) for s in self.seg], np.int64)
        # the largest impact that is left in a component once a segment of it is done
        self.next = np.zeros(len(self.seg), np.int64)
        if len(self.seg) > 1:
            same = self.comp[1:] == self.comp[:-1]
            self.next[:-1] = np.where(same, self.top[1:], 0)
        first = np.flatnonzero(np.concatenate([[True], self.comp[1:] != self.comp[:-1]])) if len(comp) else np.empty(0, np.int64)
        self.ceil[self.comp[first]] = self.top[first]

    def search(self, qid: int | None, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids and exact scores of the k best rows, and whether a proof ended the walk early."""
        own = self.ids == qid
        n = len(self.ids)
        impact = np.abs(q)[self.comp] * self.top
        walk = np.argsort(-impact, kind="stable")
        walk = walk[impact[walk] > 0]
        score = np.zeros(n, np.int64)
        score[own] = np.iinfo(np.int64).min // 2
        left = int((np.abs(q) * self.ceil).sum())  # bound of what a score can still change
        done, step, look, proved = 0, max(1, int(self.size[walk].sum()) // ROUNDS), 0, False
        member = None
        for s in walk:
            j, _, rows, values = self.seg[s]
            score[rows] += q[j] * values
            left -= abs(int(q[j])) * int(self.top[s] - self.next[s])
            done += len(rows)
            if done >= look + step and n > FEW * k:
                look = done
                bar = np.partition(score, n - k)[n - k] - left
                can = np.flatnonzero(score + left >= bar)
                if len(can) <= FEW * k:
                    member, proved = can, True
                    break
        member = np.arange(n) if member is None else member
        member = member[~own[member]]
        exact = self.x[member] @ q
        best = np.lexsort((self.ids[member], -exact))[:k]
        return self.ids[member[best]], exact[best], proved


def integers(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the usable vectors."""
    x = F.col("embedding")
    ok = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return df.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"))


def _matrix(col: pa.Array, d: int | None = None) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.int64)
    d = int(size.max(initial=0)) if d is None else d
    out = np.zeros((len(size), d), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row[at < d], at[at < d]] = flat[at < d]
    return out


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Rows dealt to ``n`` blocks of about ``size`` rows by a hash of all they hold; (block, ids, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            m = _matrix(t["v"])
            cols = [pa.array([now], pa.int64()), pa.array([t["id"].to_numpy().astype("<i8").tobytes()]), pa.array([m.astype("<i8").tobytes()]), pa.array([m.shape[1]], pa.int32())]
            return pa.RecordBatch.from_arrays(cols, ["block", "ids", "x", "d"])

        for b in batches:
            block = b["block"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for s, e in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if held and (block[s] != now or sum(h.num_rows for h in held) >= 2 * size):
                    yield close()
                    held = []
                now = int(block[s])
                held.append(b.slice(s, e - s))
        if held:
            yield close()

    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(n)).alias("block"), "id", "v")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, ids binary, x binary, d int")


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query; both sides are (id, v)."""
    n = max(1, -(-rows.count() // SHARD_ROWS))
    shards = _blocks(rows, SHARD_ROWS, n)
    filled = F.coalesce(F.array_max(F.transform("v", lambda x, i: F.when(x != 0, i + 1).otherwise(0))), F.lit(0))
    queries = queries.select("id", F.slice("v", F.lit(1), filled).alias("v")).distinct()  # zeros at the end say nothing
    blocks = _blocks(queries, QUERY_ROWS, max(1, -(-queries.count() // QUERY_ROWS)))
    sent = blocks.select(F.col("ids").alias("qids"), F.col("x").alias("qx"), F.col("d").alias("qd"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))
    pairs = shards.join(sent, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                d = max(r["d"], r["qd"])
                if key != (r["ids"], d):
                    x = np.frombuffer(r["x"], "<i8").reshape(len(ids), r["d"])
                    key, shard = (r["ids"], d), Shard(ids, np.pad(x, ((0, 0), (0, d - r["d"]))))
                qids = np.frombuffer(r["qids"], "<i8")
                qx = np.pad(np.frombuffer(r["qx"], "<i8").reshape(len(qids), r["qd"]), ((0, 0), (0, d - r["qd"])))
                out = [(int(i), xxhash.xxh3_64_intdigest(np.trim_zeros(q, "b").tobytes()) >> 1, *shard.search(int(i), q, k)[:2]) for i, q in zip(qids, qx, strict=True)]
                size = [len(o[2]) for o in out]
                cols = [np.repeat([o[0] for o in out], size), np.repeat([o[1] for o in out], size), np.concatenate([o[2] for o in out]), np.concatenate([o[3] for o in out])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "query", "vec_id", "score"])
        trim()

    found = pairs.mapInArrow(run, "query_id long, query long, vec_id long, score long")
    w = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ship(__name__)


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = cut(integers(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(rows.where(F.col("id") % 100 == 0), rows, 10)


SQL = {
    "op2_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
