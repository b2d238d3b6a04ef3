"""The whole run: sources -> claims -> entities -> profiles -> (projected) records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.fuse import profiles
from ..operators.normalize import normalize_claims
from ..operators.resolve import resolve
from ..operators.storage import cut
from ..sources.adapters import extract, split_errors
from .project import Config, parse_config, project

CANONICAL = ["candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "provenance", "overall_confidence"]


@dataclass
class Result:
    """``profiles`` by candidate_id with field_confidence and notes; ``records`` if a config was given; ``drops`` are all
    dropped claims, also those of records of which nothing was kept; ``failed`` are sources that no adapter could read to
    the end (name, reason)."""

    profiles: DataFrame
    drops: DataFrame
    failed: DataFrame
    records: DataFrame | None = None
    config: Config | None = None

    def diagnostics(self) -> DataFrame:
        """Distinct notes in order of first appearance over the profiles."""
        notes = self.profiles.select("candidate_id", F.posexplode("notes").alias("pos", "message"))
        first = notes.groupBy("message").agg(F.min(F.struct("candidate_id", "pos")).alias("at"))
        return first.orderBy("at").select("message")


def from_memory(spark: SparkSession, sources: list[tuple[str, str, str]]) -> DataFrame:
    """Sources (type, name, content) given as values, in their order."""
    rows = [(i, t, n, n, c) for i, (t, n, c) in enumerate(sources)]
    return spark.createDataFrame(rows, "source_ord long, type string, name string, path string, content string")


def violations() -> dict[str, F.Column]:
    """Constraints of the canonical profile: name -> broken?"""
    bad_items = lambda c, p: F.exists(c, lambda x: ~x.rlike(p))
    month = lambda c, extra="": c.isNotNull() & ~c.rlike(rf"^(?:[0-9]{{4}}-(?:0[1-9]|1[0-2]){extra})\z")
    return {
        "emails": bad_items("emails", S.EMAIL), "phones": bad_items("phones", S.E164),
        "location.country": F.col("location.country").isNotNull() & ~F.col("location.country").rlike(S.ISO2),
        "years_experience": F.col("years_experience").isNotNull() & ~F.col("years_experience").between(0, 80),
        "overall_confidence": ~F.col("overall_confidence").between(0, 1),
        "skills": F.exists("skills", lambda s: (F.length(s["name"]) == 0) | ~s["confidence"].between(0, 1)),
        "experience": F.exists("experience", lambda e: month(e["start"]) | month(e["end"], "|present")),
        "education": F.exists("education", lambda e: e["end_year"].isNotNull() & ~e["end_year"].between(1900, 2100)),
    }


def validate(df: DataFrame) -> None:
    """Raise if a profile breaks the canonical schema. An action: Spark is lazy, so this is asked for explicitly."""
    found = F.array_compact(F.array(*[F.when(bad, name) for name, bad in violations().items()]))
    row = df.select("candidate_id", found.alias("broken")).where(F.size("broken") > 0).first()
    if row:
        raise ValueError(f"profile {row['candidate_id']} breaks the canonical schema: {', '.join(row['broken'])}")


def transform(sources: DataFrame, config: dict | Config | None = None, default_country: str | None = None) -> Result:
    """Resolve and fuse ``sources`` (source_ord, type, name, path, content). A bad config fails before any work."""
    parsed = parse_config(config) if config is not None and not isinstance(config, Config) else config
    return transform_claims(cut(extract(sources), "claims"), parsed, default_country)


def transform_claims(claims: DataFrame, config: dict | Config | None = None, default_country: str | None = None) -> Result:
    """``transform`` from stored claims, such as those that ``streaming.ingest`` gathers."""
    parsed = parse_config(config) if config is not None and not isinstance(config, Config) else config
    claims, failed = split_errors(claims)
    normalized, drops = normalize_claims(claims, default_country)
    cluster = cut(resolve(normalized), "clusters")
    fused = profiles(normalized.join(cluster, "rec"))
    notes = drops.join(cluster, "rec").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rec", "emit_ord", "message"))), lambda n: n["message"]).alias("notes"))
    out = fused.join(notes, "cluster", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>"))).drop("cluster")
    out = cut(out, "profiles")
    return Result(out, drops, failed, project(out, parsed) if parsed else None, parsed)





