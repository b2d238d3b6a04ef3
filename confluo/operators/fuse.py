"""Entities -> profiles: aggregation by entity, corroboration, ranking, assembly.

Claims are dealt and sorted by entity once, and each entity's are walked once, in Arrow batches (``fused``). ``value_groups``,
``experience_groups`` and ``education_groups`` state the same groups as aggregates and windows over columns. A value's contributors are sorted and walked once, so one that many sources back costs time in proportion to them. What one entity has is one task's: its profile is one row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import scalars as S
from .storage import spread

SINGLES = ["full_name", "headline", "years_experience", "location.city", "location.region", "location.country", "links.linkedin", "links.github", "links.portfolio"]
MULTIS = ["email", "phone", "links.other", "skill"]
#: Fields in the order in which provenance lists them.
ORDER = [*SINGLES, "email", "phone", "links.other", "skill", "experience", "education"]
PREFIX = {"email": "emails", "phone": "phones", "links.other": "links.other", "skill": "skills"}


def trust(c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in dims.SOURCE_TRUST.items()])


def contributors() -> Column:
    """Aggregate: who says so, with which confidence; ``corroborate`` wants them sorted."""
    return F.array_sort(F.collect_set(F.struct("src_id", "method", "confidence")))


def corroborate(by: Column) -> Column:
    """struct(confidence, n) of sorted contributors: noisy-or of each source's best, and the number of sources. One walk."""
    start = F.struct(F.lit("").alias("src"), F.lit(0.0).alias("best"), F.lit(1.0).alias("miss"), F.lit(0).alias("n"))

    def add(s: Column, c: Column) -> Column:
        same = (s["n"] > 0) & (s["src"] == c["src_id"])
        best = S.clamp01(c["confidence"])
        return F.struct(
            c["src_id"].alias("src"), F.when(same, F.greatest(s["best"], best)).otherwise(best).alias("best"),
            F.when(same, s["miss"]).otherwise(s["miss"] * (F.lit(1.0) - s["best"])).alias("miss"), F.when(same, s["n"]).otherwise(s["n"] + 1).alias("n"),
        )

    done = lambda s: F.struct(S.round4(S.clamp01(F.lit(1.0) - s["miss"] * (F.lit(1.0) - s["best"]))).alias("confidence"), s["n"].alias("n"))
    return F.aggregate(by, start, add, done)


def fold_case(claims: DataFrame) -> Column:
    """The default key of a value: skills regardless of case."""
    return F.when(F.col("path") == "skill", F.lower("value")).otherwise(F.col("value"))


def value_groups(claims: DataFrame, key=fold_case) -> DataFrame:
    """Ranked values: cluster, path, key, value, confidence, by (contributors), n (sources), rank from 0. ``key``: the frame ->
    a Column under which values are one."""
    rows = claims.where("value IS NOT NULL")
    rows = rows.withColumn("key", key(rows)).repartition("cluster")
    shown = F.min(F.struct((-S.upper_count(F.col("value"))).alias("u"), F.col("value").alias("v")))
    groups = rows.groupBy("cluster", "path", "key").agg(contributors().alias("by"), shown.alias("shown"), F.max(trust(F.col("src_type"))).alias("trust"))
    groups = groups.withColumn("c", corroborate(F.col("by"))).select("cluster", "path", "key", F.col("shown.v").alias("value"), "by", "trust", "c.confidence", "c.n")
    order = W.partitionBy("cluster", "path").orderBy(F.desc("confidence"), F.desc("n"), F.desc("trust"), F.asc("value"))
    return groups.withColumn("rank", F.row_number().over(order) - 1)


def _first(field: str) -> Column:
    """First value that is not null, in claim order."""
    return F.min(F.when(F.col(field).isNotNull(), F.struct("seq", F.col(field).alias("v"))))["v"]


def experience_groups(claims: DataFrame) -> DataFrame:
    """cluster, entry, by, rank: roles merged by folded company and title; a company without a title backs the first
    titled role there, where there is one."""
    fields = ["company", "title", "start", "end", "summary"]
    fold_title = F.regexp_replace(F.lower(F.coalesce("exp.title", F.lit(""))), "[^a-z0-9]", "")
    seq = F.struct("rec", "emit_ord")
    rows = claims.where("exp IS NOT NULL").select("cluster", F.coalesce(S.fold_company(F.col("exp.company")), F.lit("")).alias("c"), fold_title.alias("t"), seq.alias("seq"), "src_id", "method", "confidence", *[F.col(f"exp.{f}").alias(f) for f in fields]).repartition("cluster")
    host = F.min(F.when(F.col("t") != "", F.struct("seq", "t"))).over(W.partitionBy("cluster", "c"))
    rows = rows.withColumn("host", host["t"])
    backs = (F.col("t") == "") & (F.col("c") != "") & F.col("host").isNotNull()
    rows = rows.withColumns({"seq": F.struct(backs.alias("late"), F.col("seq.rec"), F.col("seq.emit_ord")), "t": F.when(backs, F.col("host")).otherwise(F.col("t"))})
    end = F.when(F.max(F.coalesce(F.col("end") == "present", F.lit(False))), "present").otherwise(_first("end"))
    entry = F.struct(*[(end if f == "end" else _first(f)).alias(f) for f in fields])
    order = W.partitionBy("cluster").orderBy(
        F.desc(F.coalesce(F.col("entry.end") == "present", F.lit(False))), F.desc(F.coalesce("entry.start", F.lit("0000-00"))), F.coalesce("entry.company", F.lit("")), "seq"
    )
    return _entries(rows, entry, order)


def _entries(rows: DataFrame, entry: Column, order: W) -> DataFrame:
    """cluster, entry, by, confidence, rank of rows merged by c and t."""
    merged = rows.groupBy("cluster", "c", "t").agg(entry.alias("entry"), F.min("seq").alias("seq"), contributors().alias("by"))
    return merged.select("cluster", "entry", "by", corroborate(F.col("by"))["confidence"].alias("confidence"), (F.row_number().over(order) - 1).alias("rank"))


def education_groups(claims: DataFrame) -> DataFrame:
    fields = ["institution", "degree", "field", "end_year"]
    fold_degree = F.regexp_replace(F.lower(F.coalesce("edu.degree", F.lit(""))), "[^a-z0-9]", "")
    rows = claims.where("edu IS NOT NULL").select("cluster", F.coalesce(S.fold_company(F.col("edu.institution")), F.lit("")).alias("c"), fold_degree.alias("t"), F.struct("rec", "emit_ord").alias("seq"), "src_id", "method", "confidence", *[F.col(f"edu.{f}").alias(f) for f in fields]).repartition("cluster")
    entry = F.struct(*[_first(f).alias(f) for f in fields])
    return _entries(rows, entry, W.partitionBy("cluster").orderBy(F.desc(F.coalesce("entry.end_year", F.lit(0))), "seq"))


def _provenance(field: Column, by: Column) -> Column:
    """Each source and method of sorted contributors once."""
    same = lambda c, d: (c["src_id"] == d["src_id"]) & (c["method"] == d["method"])
    first = F.filter(by, lambda c, i: (i == 0) | ~same(c, F.get(by, i - 1)))
    return F.transform(first, lambda c: F.struct(field.alias("field"), c["src_id"].alias("source"), c["method"].alias("method")))


def _round(miss: float) -> float:
    c = 1.0 - miss
    return math.floor((0.0 if c != c else min(1.0, max(0.0, c))) * 1e4 + 0.5) / 1e4


def _backed(said: set[tuple]) -> tuple[list[tuple], float, int]:
    """Sorted contributors, ``corroborate``d confidence, number of sources."""
    if len(said) == 1:
        ((_, _, conf),) = said
        return list(said), _round(1.0 - (0.0 if conf is None or conf != conf else min(1.0, max(0.0, conf)))), 1
    by = sorted(said, key=lambda c: [(x is not None, x) for x in c])
    best: dict = {}
    for src, _, conf in by:
        conf = 0.0 if conf is None or conf != conf else min(1.0, max(0.0, conf))
        best[src] = max(best.get(src, conf), conf)
    miss = 1.0
    for conf in best.values():
        miss *= 1.0 - conf
    return by, _round(miss), len(best)


def _ranked_values(rows: list[tuple]) -> Iterator[tuple[str, list[tuple]]]:
    """(path, [(entry, by, confidence)]) of one entity, ranked as in ``value_groups``. Rows: path, key, value, contributor, trust."""
    groups: dict = {}
    for path, key, value, said, trusted in rows:
        g = groups.setdefault(path, {}).setdefault(key, (set(), set(), []))
        g[0].add(value)
        g[1].add(said)
        g[2].append(trusted)
    for path, of in groups.items():
        out = []
        for values, said, trusts in of.values():
            shown = min(values, key=lambda v: (-sum("A" <= ch <= "Z" for ch in v), v)) if len(values) > 1 else next(iter(values))
            by, conf, n = _backed(said)
            out.append(((-conf, -n, -max((t for t in trusts if t is not None), default=-math.inf), shown), ((shown,), by, conf)))
        yield path, [g for _, g in sorted(out, key=lambda x: x[0])]


def _merged(rows: list[tuple], width: int) -> list[tuple]:
    """(entry, by, confidence, seq) of rows (c, t, seq, entry, contributor) merged by c and t; a field is the first that is not null."""
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[:2], []).append(row)
    out = []
    for of in groups.values():
        of.sort(key=lambda r: r[2])
        entry = tuple(next((r[3][i] for r in of if r[3][i] is not None), None) for i in range(width))
        out.append((entry, *_backed({r[4] for r in of})[:2], of[0][2], of))
    return out


def _roles(rows: list[tuple]) -> list[tuple]:
    """Entries as in ``experience_groups``."""
    host: dict = {}
    for c, t, seq, _, _ in rows:
        if t and (c not in host or (seq, t) < host[c]):
            host[c] = (seq, t)
    placed = [(c, host[c][1], (True, *seq), e, said) if not t and c and c in host else (c, t, (False, *seq), e, said) for c, t, seq, e, said in rows]
    out = [((*e[:3], "present" if any(r[3][3] == "present" for r in of) else e[3], e[4]), by, conf, seq) for e, by, conf, seq, of in _merged(placed, 5)]
    out.sort(key=lambda g: (g[0][0] or "", g[3]))
    out.sort(key=lambda g: (g[0][3] == "present", "0000-00" if g[0][2] is None else g[0][2]), reverse=True)
    return out


def _schools(rows: list[tuple]) -> list[tuple]:
    """Entries as in ``education_groups``."""
    return sorted(_merged(rows, 4), key=lambda g: (-(g[0][3] or 0), g[3]))


class _Groups:
    """Lists of (entry, contributors, confidence), gathered column by column."""

    def __init__(self, *fields: tuple[str, pa.DataType]):
        self.fields, self.entries, self.conf, self.by, self.by_at, self.at = fields, [[] for _ in fields], [], ([], [], []), [0], [0]

    def add(self, groups: list[tuple]) -> None:
        for entry, by, conf, *_ in groups:
            for column, x in zip(self.entries, entry, strict=True):
                column.append(x)
            for c in by:
                for column, x in zip(self.by, c, strict=True):
                    column.append(x)
            self.by_at.append(len(self.by[0]))
            self.conf.append(conf)
        self.at.append(len(self.conf))

    def lists(self) -> pa.ListArray:
        by = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(self.by, (pa.string(), pa.string(), pa.float64()), strict=True)], ["src_id", "method", "confidence"])
        entry = [pa.array(c, t) for c, (_, t) in zip(self.entries, self.fields, strict=True)]
        held = ("value", entry[0]) if len(entry) == 1 else ("entry", pa.StructArray.from_arrays(entry, [n for n, _ in self.fields]))
        each = pa.StructArray.from_arrays([held[1], pa.ListArray.from_arrays(pa.array(self.by_at, pa.int32()), by), pa.array(self.conf, pa.float64())], [held[0], "by", "confidence"])
        return pa.ListArray.from_arrays(pa.array(self.at, pa.int32()), each)


_BY = "by:array<struct<src_id:string,method:string,confidence:double>>,confidence:double"
_FUSED = (
    f"cluster long, first_record string, v map<string,array<struct<value:string,{_BY}>>>, x array<struct<entry:struct<company:string,title:string,start:string,end:string,summary:string>,{_BY}>>, "
    f"d array<struct<entry:struct<institution:string,degree:string,field:string,end_year:int>,{_BY}>>"
)
_COLUMNS = ["cluster", "rec", "emit_ord", "record_id", "path", "key", "value", "src_id", "method", "confidence", "trust", "kind", "c", "t", "e0", "e1", "e2", "e3", "e4", "year"]
ENTITIES = 1_000  # of an Arrow batch


def _values(c: pa.Array) -> list:
    """``to_pylist``, by way of numpy where that keeps nulls and whole numbers: a fraction of the time."""
    return c.to_numpy(zero_copy_only=False).tolist() if c.null_count == 0 or pa.types.is_string(c.type) else c.to_pylist()


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The claims of one entity after the other, from batches in the order of entities."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(_values(b[c]) for c in _COLUMNS), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims in the order of entities -> what the profile of each is made of; one entity is held at a time."""
    text = lambda *names: [(n, pa.string()) for n in names]
    every = _entities(batches)
    while some := list(islice(every, ENTITIES)):
        values, roles, schools = _Groups(("value", pa.string())), _Groups(*text("company", "title", "start", "end", "summary")), _Groups(*text("institution", "degree", "field"), ("end_year", pa.int32()))
        paths, at, first = [], [0], []
        for claims in some:
            said, jobs, studies = [], [], []
            for _, rec, emit, _, path, key, value, src, method, conf, trusted, kind, c, t, *e, year in claims:
                by = (src, method, conf)
                if value is not None:
                    said.append((path, key, value, by, trusted))
                if kind == "x":
                    jobs.append((c, t, (rec, emit), e, by))
                elif kind == "d":
                    studies.append((c, t, (rec, emit), (*e[:3], year), by))
            for path, groups in _ranked_values(said):
                paths.append(path)
                values.add(groups)
            at.append(len(paths))
            roles.add(_roles(jobs))
            schools.add(_schools(studies))
            first.append(min((r[1], r[3]) for r in claims)[1])
        v = pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array(paths, pa.string()), values.lists())
        yield pa.RecordBatch.from_arrays([pa.array([claims[0][0] for claims in some], pa.int64()), pa.array(first, pa.string()), v, roles.lists(), schools.lists()], ["cluster", "first_record", "v", "x", "d"])


def profiles(claims: DataFrame) -> DataFrame:
    """One row per entity: the canonical profile, field_confidence map and cluster. ``claims`` has ``cluster``."""
    job, school = F.col("exp").isNotNull(), F.col("edu").isNotNull()
    both = lambda e, d: F.when(job, F.col(f"exp.{e}")).otherwise(F.col(f"edu.{d}"))
    rows = claims.select(
        "cluster", "rec", "emit_ord", "record_id", "path", fold_case(claims).alias("key"), "value", "src_id", "method", "confidence", trust(F.col("src_type")).alias("trust"), F.when(job, "x").when(school, "d").alias("kind"),
        F.when(job | school, F.coalesce(S.fold_company(both("company", "institution")), F.lit(""))).alias("c"), F.when(job | school, F.regexp_replace(F.lower(F.coalesce(both("title", "degree"), F.lit(""))), "[^a-z0-9]", "")).alias("t"),
        both("company", "institution").alias("e0"), both("title", "degree").alias("e1"), both("start", "field").alias("e2"), F.col("exp.end").alias("e3"), F.col("exp.summary").alias("e4"), F.col("edu.end_year").alias("year"),
    )
    df = spread(rows, "cluster").sortWithinPartitions("cluster").mapInArrow(lambda batches: fused(batches), _FUSED)

    def ranked(path: str) -> Column:
        return F.coalesce(F.try_element_at("v", F.lit(path)), F.array())

    names = {p: "g_" + p.replace(".", "_") for p in [*SINGLES, *MULTIS]}
    df = df.withColumns({n: ranked(p) for p, n in names.items()})
    top = lambda p: F.get(F.col(names[p]), 0)
    df = df.withColumns({"s_" + names[p]: top(p) for p in SINGLES})
    one = lambda p: F.col("s_" + names[p])
    special = F.array(*[one(f"links.{k}")["value"] for k in ("linkedin", "github", "portfolio")])
    df = df.withColumn(names["links.other"], F.filter(names["links.other"], lambda g: ~F.coalesce(F.array_contains(F.array_compact(special), g["value"]), F.lit(False))))
    x, d = F.coalesce("x", F.array()), F.coalesce("d", F.array())
    fields = []  # (field name, confidence, by) of everything, in order
    unit = lambda name, g: F.struct(name.alias("field"), g["confidence"].alias("confidence"), g["by"].alias("by"))
    for p in SINGLES:
        fields.append(F.when(one(p).isNotNull(), F.array(unit(F.lit(p), one(p)))).otherwise(F.array()))
    at = lambda prefix, i: F.concat(F.lit(prefix + "["), i.cast("string"), F.lit("]"))
    several = lambda prefix, arr: F.transform(arr, lambda g, i: unit(at(prefix, i), g))
    fields += [several(PREFIX[p], F.col(names[p])) for p in MULTIS]
    fields += [several("experience", x), several("education", d)]
    df = df.withColumn("fields", F.concat(*fields))
    df = df.withColumns({
        "field_confidence": F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["confidence"]))),
        "provenance": F.flatten(F.transform("fields", lambda f: _provenance(f["field"], f["by"]))),
        "emails": F.transform(names["email"], lambda g: g["value"]), "phones": F.transform(names["phone"], lambda g: g["value"]),
        "experience": F.transform(x, lambda g: g["entry"]), "education": F.transform(d, lambda g: g["entry"]),
    })
    with_company = F.get(F.filter("experience", lambda e: e["company"].isNotNull() & (e["company"] != "")), 0)["company"]
    df = df.withColumn("name_key", S.name_key(one("full_name")["value"]))
    named = F.when(one("full_name").isNotNull() & with_company.isNotNull(), F.concat_ws("|", "name_key", S.fold_company(with_company)))
    seed = F.coalesce(F.get("emails", 0), F.get("phones", 0), S.github_handle(one("links.github")["value"]), named, F.col("first_record"), F.lit("unknown"))
    mean = lambda arr: S.round4(F.aggregate(arr, F.lit(0.0), lambda a, g: a + g["confidence"]) / F.size(arr))
    best = lambda arr: F.array_max(F.transform(arr, lambda g: g["confidence"]))
    links = F.array_max(F.array_compact(F.concat(F.array(*[one(f"links.{k}")["confidence"] for k in ("linkedin", "github", "portfolio")]), F.transform(names["links.other"], lambda g: g["confidence"]))))
    present = {
        "full_name": one("full_name")["confidence"], "emails": top("email")["confidence"], "phones": top("phone")["confidence"],
        "location.country": one("location.country")["confidence"], "headline": one("headline")["confidence"],
        "skills": F.when(F.size(names["skill"]) > 0, mean(F.col(names["skill"]))), "experience": best(x), "education": best(d), "links": links,
    }
    total = lambda f: sum((f(k, c) for k, c in present.items()), F.lit(0.0))
    weighted = total(lambda k, c: F.coalesce(F.lit(float(dims.OVERALL_WEIGHTS[k])) * S.clamp01(c), F.lit(0.0)))
    weight = total(lambda k, c: F.when(c.isNotNull(), float(dims.OVERALL_WEIGHTS[k])).otherwise(0.0))
    val = lambda p: one(p)["value"]
    skills = F.transform(names["skill"], lambda g: F.struct(g["value"].alias("name"), g["confidence"].alias("confidence"), F.array_sort(F.array_distinct(F.transform(g["by"], lambda c: c["src_id"]))).alias("sources")))
    return df.select(
        S.candidate_id(seed).alias("candidate_id"), val("full_name").alias("full_name"), "emails", "phones",
        F.struct(*[val(f"location.{k}").alias(k) for k in ("city", "region", "country")]).alias("location"),
        F.struct(*[val(f"links.{k}").alias(k) for k in ("linkedin", "github", "portfolio")], F.transform(names["links.other"], lambda g: g["value"]).alias("other")).alias("links"),
        val("headline").alias("headline"), val("years_experience").cast("double").alias("years_experience"), skills.alias("skills"), "experience", "education", "provenance",
        F.when(weight > 0, S.round4(S.clamp01(weighted / F.when(weight > 0, weight)))).otherwise(0.0).alias("overall_confidence"), "field_confidence", "cluster",
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
