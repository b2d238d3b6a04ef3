"""Scans: files and directories -> a frame of whole sources and a frame of skipped files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from ..operators.order import numbered

SOURCES = "source_ord long, type string, name string, path string, content string"
DOCX_REASON = "DOCX is not supported; export it as PDF or text"
PDF_REASON = "no PDF text extractor is configured"


def looks_like_github(content: Column) -> Column:
    keys = F.json_object_keys(content)
    return F.coalesce(F.array_contains(keys, "user") | F.array_contains(keys, "repos"), F.lit(False))


def detect_type(name: Column, content: Column) -> Column:
    """Source type from file name and content; null for what no adapter reads."""
    low = F.lower(name)
    ext = F.regexp_extract(low, r"\.([^.]*)\z", 1)
    text = F.when(low.contains("resume") | low.rlike(r"(^|[^a-z])cv([^a-z]|\z)"), "resume").when(low.contains("github"), "github").when(low.contains("linkedin"), "linkedin").otherwise("notes")
    return F.when(ext == "csv", "csv").when(ext == "json", F.when(looks_like_github(content), "github").otherwise("ats_json")).when(ext.isin("txt", "md", ""), text)


def _unseen(spark: SparkSession, root: str) -> Iterator[str]:
    """Files below ``root``, or itself, that Spark's readers leave out for a name (or folder) that starts with ``_``. Names
    that start with a dot are left out on purpose. The driver lists names only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.getFileStatus(path).getPath().toString()
    found = fs.listFiles(path, True)
    while found.hasNext():
        full = found.next().getPath().toString()
        names = full[len(base) + 1 :].split("/") if full != base else [base.rsplit("/", 1)[-1]]
        if any(n.startswith("_") and "=" not in n and not n.startswith(("_metadata", "_common_metadata")) for n in names) and not any(n.startswith(".") for n in names):
            yield full


def _binary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, raw) of all files, also of those whose names Spark's readers leave out: these get other names by a mount table."""
    unseen = sorted({f for p in paths for f in _unseen(spark, p)})
    mounts = f"files-{uuid.uuid4().hex}"
    links = {f"viewfs://{mounts}/f{i}": f for i, f in enumerate(unseen)}
    for link, file in links.items():
        spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{mounts}.link./{link.rsplit('/', 1)[-1]}", file)
    read = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", F.col("content").alias("raw"))
    seen = read(paths)
    return seen.union(read(list(links)).withColumn("path", lookup(links, F.col("path")))) if links else seen


def load_sources(spark: SparkSession, paths: list[str], pdf_text=None) -> tuple[DataFrame, DataFrame]:
    """(sources, skipped). Directories are read recursively, without names that start with a dot; a path that doesn't exist
    is reported as skipped.

    ``pdf_text``: Column of bytes -> Column of text, for sites that have an extractor (``text_extractor`` makes one of a
    function).
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there, missing = [], []
    for p in paths:
        at = hadoop(p)
        (there if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else missing).append(p)
    gone = spark.createDataFrame([(p.rsplit("/", 1)[-1], p, "file not found") for p in missing], "name string, path string, reason string")
    if not there:
        return spark.createDataFrame([], SOURCES), gone
    files = _binary(spark, there).withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("name").startswith("."))
    ext = F.regexp_extract(F.lower("name"), r"\.([^.]*)\z", 1)
    # cast, unlike decode(), keeps bad bytes as replacement characters instead of raising
    text = F.regexp_replace(F.col("raw").cast("string"), "^\\uFEFF", "")
    text = F.when(ext == "pdf", pdf_text(F.col("raw"))).otherwise(text) if pdf_text else text
    named = files.withColumn("content", text)
    kind = F.when(F.lit(pdf_text is not None) & (ext == "pdf"), "resume").otherwise(detect_type(F.col("name"), F.col("content")))
    named = named.withColumn("type", kind)
    why = F.when(ext == "docx", DOCX_REASON).when(ext == "pdf", PDF_REASON).otherwise(F.concat(F.lit("unsupported file type: "), ext))
    skipped = gone.unionByName(named.where("type IS NULL").select("name", "path", why.alias("reason")))
    # The order of sources is that of base names, as everything after it keeps that order.
    ords = numbered(named.where("type IS NOT NULL").select("name", "path"), ["name", "path"], "source_ord").drop("name")
    return named.where("type IS NOT NULL").join(ords, "path").select("source_ord", "type", "name", "path", "content"), skipped


def text_extractor(name: str):
    """``package.module:function`` (bytes -> text) as a Column of bytes -> Column of text."""
    import importlib

    module, _, function = name.partition(":")
    f = getattr(importlib.import_module(module), function)
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else f(bytes(b))).astype(object), "string")
