"""Incremental ingest: files that arrive in a folder become stored claims, each batch once.

An extension: the batch run over all claims (``transform_claims``) stays the one that resolves and fuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.order import numbered
from ..sources.adapters import extract
from ..sources.load import detect_type

FILES = "path string, name string, source_ord long, batch long"


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Extract the claims of all files not seen before, then stop. A file's number follows those of the batches before, so no
    two files share one; a batch that runs again numbers its files alike and replaces its own rows."""
    text = spark.readStream.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    files = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "^\\uFEFF", "").alias("content"))
    typed = files.withColumn("type", detect_type(F.col("name"), F.col("content"))).where("type IS NOT NULL")

    def add(batch: DataFrame, number: int) -> None:
        last = _files(spark, out).where(F.col("batch") < number).agg(F.max("source_ord")).first()[0]
        ords = numbered(batch.select("path", "name"), ["name", "path"], "n").select("path", "name", (F.col("n") + (0 if last is None else last + 1)).alias("source_ord"))
        ords.write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        kept = spark.read.parquet(f"{out}/files/batch={number}")
        extract(batch.join(kept.select("path", "source_ord"), "path")).write.mode("overwrite").parquet(f"{out}/claims/batch={number}")

    return typed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, out: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/files")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(FILES).parquet(f"{out}/files") if there else spark.createDataFrame([], FILES)


def stored(spark: SparkSession, out: str) -> DataFrame:
    """All claims, with sources in the order of their base names, as a batch scan of the folder would have them."""
    ords = numbered(_files(spark, out).select("name", "path", F.col("source_ord").alias("old")), ["name", "path"], "new").select("old", "new")
    claims = spark.read.parquet(f"{out}/claims").drop("batch")
    moved = claims.join(ords, F.col("source_ord") == F.col("old")).withColumns({"source_ord": F.col("new"), "rec": F.shiftleft("new", 32) + F.col("record_idx")})
    return moved.select(claims.columns)
