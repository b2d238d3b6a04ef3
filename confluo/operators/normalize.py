"""Claims -> normalized claims and drop notes: one projection, kept once, and two filters of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .storage import cut

# What a drop note says about each path.
REASONS = {
    "full_name": "not a valid name", "email": "invalid email", "phone": "not a valid E.164 phone", "location.city": "blank",
    "location.region": "blank", "headline": "blank", "location.country": "unrecognized country", "links.linkedin": "invalid url",
    "links.github": "invalid url", "links.portfolio": "invalid url", "links.other": "invalid url",
    "years_experience": "not a plausible year count", "skill": "blank skill", "experience": "empty experience", "education": "empty education",
}


def _experience(e: Column) -> Column:
    out = F.struct(
        S.clean_text(e["company"]).alias("company"), S.clean_text(e["title"]).alias("title"), S.normalize_month(e["start"]).alias("start"),
        S.normalize_end(e["end"]).alias("end"), S.clean_text(e["summary"]).alias("summary"),
    )
    return F.when(out["company"].isNotNull() | out["title"].isNotNull(), out)


def _education(e: Column) -> Column:
    out = F.struct(
        S.clean_text(e["institution"]).alias("institution"), S.clean_text(e["degree"]).alias("degree"),
        S.clean_text(e["field"]).alias("field"), S.extract_year(e["end_year"]).alias("end_year"),
    )
    return F.when(out["institution"].isNotNull() | out["degree"].isNotNull(), out)


def normalize_claims(claims: DataFrame, default_country: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(normalized, drops), from one pass that is kept in shared storage. Normalized claims carry ``value`` (text), ``exp`` or
    ``edu``; drops carry ``message``."""
    v, path = F.col("v_str"), F.col("path")
    skill = S.normalize_skill(v)
    years = F.when(F.col("v_num").isNotNull(), F.when(F.col("v_num").between(0, 80), F.floor(F.col("v_num") + 0.5).cast("double"))).otherwise(S.parse_years(v))
    value = (
        F.when(path == "full_name", S.normalize_name(v))
        .when(path == "email", S.normalize_email(v))
        .when(path == "phone", F.when(F.col("v_num").isNull(), S.normalize_phone(v, default_country)))
        .when(path.isin("location.city", "location.region", "headline"), S.clean_text(v))
        .when(path == "location.country", S.normalize_country(v, S.country_table(claims.sparkSession)))
        .when(path.startswith("links."), S.normalize_url(v))
        .when(path == "years_experience", years.cast("int").cast("string"))
        .when(path == "skill", skill["name"])
    )
    confidence = S.round4(F.when((path == "skill") & ~skill["canonical"], F.col("confidence") * 0.9).otherwise(F.col("confidence")))
    out = claims.select(
        "record_id", "rec", "emit_ord", "path", value.alias("value"), F.when(path == "experience", _experience(F.col("v_exp"))).alias("exp"),
        F.when(path == "education", _education(F.col("v_edu"))).alias("edu"), "src_type", F.concat_ws(":", "src_type", "src_name").alias("src_id"), "method", "raw", confidence.alias("confidence"),
    )
    kept = F.coalesce(F.length("value") > 0, F.lit(False)) | F.col("exp").isNotNull() | F.col("edu").isNotNull()
    why = F.coalesce(*[F.when(path == p, F.lit(w)) for p, w in REASONS.items()])
    message = F.when(~kept, F.format_string('dropped %s="%s" from %s (%s)', path, "raw", "src_id", why))
    both = cut(out.withColumn("message", message).drop("raw"), "normalized")
    return both.where("message IS NULL").drop("message"), both.where("message IS NOT NULL").select("record_id", "rec", "emit_ord", "message")
