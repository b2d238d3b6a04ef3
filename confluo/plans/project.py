"""Config-driven projection: a runtime config is validated, compiled to a select list, and its schema checked."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

TYPES = ["string", "number", "boolean", "string[]", "number[]", "object", "object[]", "any"]
KINDS = ["E164", "canonical", "date", "country", "lower", "upper", "trim"]
POLICIES = ["null", "omit", "error"]
SEGMENT = re.compile(r"([A-Za-z_]\w*)(?:\[(\d*)\])?", re.A)


class ProjectionError(ValueError):
    """A config that can't be used, or records that break it."""


@dataclass(frozen=True)
class Field:
    path: str
    type: str
    source: str
    required: bool = False
    normalize: str | None = None


@dataclass(frozen=True)
class Config:
    fields: list[Field] = field(default_factory=list)
    include_provenance: bool = False
    include_confidence: bool = False
    on_missing: str = "null"


def parse_config(raw: object) -> Config:
    """A config from parsed JSON; unknown keys and wrong values are all reported at once."""
    issues: list[str] = []

    def want(ok: bool, where: str, what: str) -> bool:
        if not ok:
            issues.append(f"{where}: {what}")
        return ok

    if not isinstance(raw, dict):
        raise ProjectionError("Invalid output config: (root): expected an object")
    for k in raw.keys() - {"fields", "include_provenance", "include_confidence", "on_missing"}:
        want(False, k, "unknown key")
    for k in ("include_provenance", "include_confidence"):
        want(isinstance(raw.get(k, False), bool), k, "expected a boolean")
    want(raw.get("on_missing", "null") in POLICIES, "on_missing", f"expected one of {POLICIES}")
    items = raw.get("fields")
    fields = []
    if want(isinstance(items, list) and len(items) > 0, "fields", "expected at least one field"):
        for i, f in enumerate(items):
            if not want(isinstance(f, dict), f"fields.{i}", "expected an object"):
                continue
            for k in f.keys() - {"path", "from", "type", "required", "normalize"}:
                want(False, f"fields.{i}.{k}", "unknown key")
            ok = want(isinstance(f.get("path"), str) and f.get("path") != "", f"fields.{i}.path", "expected a non-empty string")
            ok &= want("from" not in f or (isinstance(f["from"], str) and f["from"] != ""), f"fields.{i}.from", "expected a non-empty string")
            ok &= want(f.get("type") in TYPES, f"fields.{i}.type", f"expected one of {TYPES}")
            ok &= want(isinstance(f.get("required", False), bool), f"fields.{i}.required", "expected a boolean")
            ok &= want("normalize" not in f or f["normalize"] in KINDS, f"fields.{i}.normalize", f"expected one of {KINDS}")
            if ok:
                fields.append(Field(f["path"], f["type"], f.get("from", f["path"]), f.get("required", False), f.get("normalize")))
    if issues:
        raise ProjectionError("Invalid output config: " + "; ".join(issues))
    return Config(fields, raw.get("include_provenance", False), raw.get("include_confidence", False), raw.get("on_missing", "null"))


def parse_path(expr: str) -> list[tuple[str, int | str | None]] | None:
    """Segments (key, index, "[]" or None); None for bad syntax."""
    found = [SEGMENT.fullmatch(p) for p in expr.split(".")]
    if not all(found):
        return None
    return [(m[1], None if m[2] is None else int(m[2]) if m[2] else "[]") for m in found]


@dataclass
class Resolved:
    """A path as columns: its value, the confidence keys that may stand behind it, and whether it fans out."""

    value: Column | None
    type: T.DataType | None
    keys: Column  # array<string> of known confidence keys, in order
    fans: bool


def resolve_path(schema: T.StructType, expr: str) -> Resolved:
    segments = parse_path(expr)
    nothing = F.array().cast("array<string>")
    if not segments:
        return Resolved(None, None, nothing, False)
    known = lambda k: F.map_contains_key("field_confidence", k)

    def nearest(path: Column, depth: int) -> Column:
        """The longest ancestor that has a confidence."""
        options, p = [], path
        for _ in range(depth):
            options.append(F.when(known(p), p))
            p = F.regexp_replace(p, r"\.[^.]*\z", "")
        return F.coalesce(*options)

    def build(of: Column | None, kind: T.DataType, rest: list, path: Column, depth: int) -> tuple[Column | None, T.DataType | None, Column, bool]:
        if not rest:
            return of, kind, F.array(nearest(path, depth)), False
        (key, at), more = rest[0], rest[1:]
        if not isinstance(kind, T.StructType) or key not in kind.names:
            return None, None, nothing, any(a == "[]" for _, a in rest)
        child = F.col(f"`{key}`") if of is None else of[key]
        inner = kind[key].dataType
        here = F.lit(key) if of is None else F.concat(path, F.lit(f".{key}"))
        if at is None:
            return build(child, inner, more, here, depth + 1)
        if not isinstance(inner, T.ArrayType):
            return None, None, nothing, at == "[]"
        if at != "[]":
            return build(F.get(child, at), inner.elementType, more, F.concat(here, F.lit(f"[{at}]")), depth + 1)
        probe = build(F.lit(None), inner.elementType, more, here, depth + 1)
        one = lambda x, i: build(x, inner.elementType, more, F.concat(here, F.lit("["), i.cast("string"), F.lit("]")), depth + 1)
        if probe[1] is None:
            return None, None, nothing, True
        values, keys = F.transform(child, lambda x, i: one(x, i)[0]), F.transform(child, lambda x, i: one(x, i)[2])
        return (F.flatten(values) if probe[3] else values), (probe[1] if probe[3] else T.ArrayType(probe[1])), F.flatten(keys), True

    value, kind, keys, fans = build(None, schema, segments, F.lit(""), 0)
    return Resolved(value, kind, F.array_compact(keys), fans)


def _normalize(value: Column, kind: T.DataType, how: str, countries: dict[str, str]) -> tuple[Column, T.DataType]:
    one = {
        "E164": S.normalize_phone, "canonical": lambda c: S.normalize_skill(c)["name"], "date": S.normalize_month,
        "country": lambda c: S.normalize_country(c, countries), "lower": F.lower, "upper": F.upper, "trim": S.trim,
    }[how]
    text = isinstance(kind.elementType if isinstance(kind, T.ArrayType) else kind, T.StringType)
    as_text = (lambda c: c) if text else (lambda c: c.cast("string"))
    if not text and how not in ("lower", "upper", "trim"):
        one = lambda c: F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.array_compact(F.transform(value, lambda x: one(as_text(x)))), T.ArrayType(T.StringType())
    return one(as_text(value)), T.StringType()


def fits(kind: T.DataType | None, wanted: str) -> bool:
    """Whether a Spark type is of a declared type; what is always null fits any."""
    if kind is None or wanted == "any":
        return True
    if wanted.endswith("[]"):
        return isinstance(kind, T.ArrayType) and fits(kind.elementType, wanted[:-2])
    return {"string": isinstance(kind, T.StringType), "number": isinstance(kind, T.NumericType), "boolean": isinstance(kind, T.BooleanType), "object": isinstance(kind, T.StructType | T.MapType | T.ArrayType)}[wanted]


def _compile(df: DataFrame, config: Config) -> list[tuple[Field, Column, T.DataType | None, Resolved]]:
    countries = S.country_table(df.sparkSession)
    out = []
    for f in config.fields:
        r = resolve_path(df.schema, f.source)
        value, kind = (F.lit(None).cast("string"), None) if r.value is None else (r.value, r.type)
        if f.normalize and kind is not None:
            value, kind = _normalize(value, kind, f.normalize, countries)
        if not fits(kind, f.type):
            raise ProjectionError(f'Projected output failed schema validation: {f.path}: expected {f.type}, got {kind.simpleString()}')
        out.append((f, value, kind, r))
    return out


def _extras(config: Config, compiled: list) -> list[Column]:
    extras = []
    if config.include_confidence:
        entries = [(f, F.when(v.isNotNull() & (F.size(r.keys) > 0), F.transform(r.keys, lambda k: F.try_element_at("field_confidence", k))), r.fans) for f, v, _, r in compiled]
        extras.append(F.struct(*[(c if fans else F.get(c, 0)).alias(f.path) for f, c, fans in entries]).alias("confidence"))
        extras.append(F.col("overall_confidence"))
    if config.include_provenance:
        used = F.flatten(F.array(*[F.when(v.isNotNull(), r.keys).otherwise(F.array().cast("array<string>")) for _, v, _, r in compiled]))
        extras.append(S.let(used, lambda u: F.filter("provenance", lambda p: F.array_contains(u, p["field"]))).alias("provenance"))
    return extras


def project(profiles: DataFrame, config: Config) -> DataFrame:
    """The configured columns, named by their literal paths. A column exists for all rows, so ``omit`` leaves null here
    and leaves keys out in ``to_records``; ``error`` raises when a row lacks a value."""
    compiled = _compile(profiles, config)
    cols = []
    for f, value, _, _ in compiled:
        if config.on_missing == "error":
            lacks = F.raise_error(F.lit(f'Missing value for field "{f.path}" (from "{f.source}")'))
            value = F.when(value.isNotNull(), value).otherwise(lacks)
        cols.append(value.alias(f.path))
    return profiles.select(*cols, *_extras(config, compiled))


def _fragment(key: str, value: Column) -> Column:
    """``"key":value`` as JSON text; nulls inside the value stay."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    import json

    return F.concat(F.lit(json.dumps(key) + ":"), F.substring(text, F.lit(6), F.length(text) - 6))


def to_records(profiles: DataFrame, config: Config) -> DataFrame:
    """One JSON object per profile in a column ``record``; ``omit`` leaves out keys without a value."""
    compiled = _compile(profiles, config)
    parts = [F.when(v.isNotNull(), _fragment(f.path, v)) if config.on_missing == "omit" else _fragment(f.path, v) for f, v, _, _ in compiled]
    if config.include_confidence:
        known = [(f, F.when(v.isNotNull() & (F.size(r.keys) > 0), F.transform(r.keys, lambda k: F.try_element_at("field_confidence", k))), r.fans) for f, v, _, r in compiled]
        inner = F.concat_ws(",", *[F.when(c.isNotNull(), _fragment(f.path, c if fans else F.get(c, 0))) for f, c, fans in known])
        parts += [F.concat(F.lit('"confidence":{'), inner, F.lit("}")), _fragment("overall_confidence", F.col("overall_confidence"))]
    if config.include_provenance:
        parts.append(_fragment("provenance", _extras(Config(include_provenance=True), compiled)[0]))
    return profiles.select("candidate_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("record"))


def validate_records(records: DataFrame, config: Config) -> None:
    """Raise if a required field is null or an array of plain values holds a null. An action."""
    checks = []
    for f in config.fields:
        c = F.col(f"`{f.path}`")
        if f.required:
            checks.append(F.when(c.isNull(), F.lit(f"{f.path}: required")))
        if f.type in ("string[]", "number[]"):
            checks.append(F.when(F.exists(c, lambda x: x.isNull()), F.lit(f"{f.path}: null in {f.type}")))
    row = records.select(F.array_compact(F.array(*checks)).alias("x")).where(F.size("x") > 0).first() if checks else None
    if row:
        raise ProjectionError("Projected output failed schema validation: " + "; ".join(row["x"]))
