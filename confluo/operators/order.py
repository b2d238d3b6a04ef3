"""Numbering rows in an order without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with a column ``name``: 0, 1, ... in the order of ``by``. Rows are dealt to ranges and sorted there; a range's
    numbers start after those of the ranges before it. ``df`` is written once."""
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    ranged = cut(ranged, "ranged")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row per range
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    return ranged.join(offsets, part == F.col("__part")).withColumn(name, F.col("__before") + place).drop("__at", "__part", "__before")
