"""Connected components over an edge frame."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

ONE_TASK_EDGES = 500_000  # 8 MB: up to here one executor task walks the edges; beyond, all executors step together


ONE_TASK_KEYS = 250_000  # the same bound for rows of a node and a key


def _labels(pairs: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    """Union-find over a bounded number of pairs."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for u, v in pairs:
        u, v = top(u), top(v)
        parent[max(u, v)] = min(u, v)
    ids = np.fromiter(parent, np.int64, len(parent))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([top(i) for i in ids.tolist()], pa.int64())], ["id", "label"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _labels(p for b in batches for p in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True))


def _walk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node is tied to the first one of its key."""
    first: dict = {}
    yield _labels((n, first.setdefault(k, n)) for b in batches for n, k in zip(b["node"].to_pylist(), b["key"].to_pylist(), strict=True))


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``edges`` (a long, b long) -> (id, label): label is the smallest id that can be reached; ids that only have an
    edge to themselves, or none, are left out.

    Alternating large-star and small-star steps; each step is kept in shared storage, nothing is collected, and the
    number of steps grows with the logarithm of the longest path. Up to ``one_task_edges`` edges, counted first, a single
    executor task does the same without a shuffle.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if e.count() <= one_task_edges:
        return e.coalesce(1).mapInArrow(lambda batches: _walk(batches), "id long, label long")
    e = cut(e.distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = cut(large.join(low, "u").select(F.explode(pairs).alias("s")).select("s.u", "s.v").where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label")).union(e.select("v", "v").distinct())
        before = now


def shared_key_components(rows: DataFrame, node: str, key: str, one_task_keys: int = ONE_TASK_KEYS) -> DataFrame:
    """Components of nodes (long) that share a key: each node is tied to the smallest node of each of its keys, so a key
    of n nodes costs n edges, not n squared. Nodes without a partner keep their own label; rows without a key are left out. Up to ``one_task_keys`` rows,
    counted first, a single executor task walks them without a shuffle."""
    rows = cut(rows.select(F.col(node).cast("long").alias("node"), F.col(key).alias("key")).where("node IS NOT NULL AND key IS NOT NULL"), "keys")
    if rows.count() <= one_task_keys:
        return rows.coalesce(1).mapInArrow(lambda batches: _walk_keys(batches), "id long, label long")
    first = rows.groupBy("key").agg(F.min("node").alias("b"))
    label = components(rows.join(first, "key").select(F.col("node").alias("a"), "b"))
    return rows.select(F.col("node").alias("id")).distinct().join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
