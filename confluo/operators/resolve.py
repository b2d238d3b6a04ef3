"""Records -> entities: connected components over strong keys, then unambiguous name and company matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .graph import components, shared_key_components
from .storage import cut


def strong_keys(claims: DataFrame) -> DataFrame:
    """(rec, key): e-mail, phone and GitHub handle of each record."""
    handle = S.github_handle(F.col("value"))
    key = (
        F.when(F.col("path") == "email", F.concat(F.lit("email:"), "value"))
        .when(F.col("path") == "phone", F.concat(F.lit("phone:"), "value"))
        .when(F.col("path") == "links.github", F.concat(F.lit("gh:"), handle))
    )
    return claims.where(F.col("path").isin("email", "phone", "links.github")).select("rec", key.alias("key")).where("key IS NOT NULL").distinct()


def name_company_keys(claims: DataFrame) -> DataFrame:
    """(rec, key, ord): last name of a record with each of its companies; ord keeps the companies' order."""
    some = claims.where(F.col("path").isin("full_name", "experience"))
    each = some.groupBy("rec").agg(
        F.max_by("value", F.when(F.col("path") == "full_name", F.col("emit_ord"))).alias("name"),
        F.array_sort(F.collect_list(F.when(F.col("exp.company").isNotNull(), F.struct("emit_ord", S.fold_company(F.col("exp.company")).alias("c"))))).alias("cs"),
    )
    rows = each.select("rec", S.name_key(F.col("name")).alias("name"), F.posexplode(F.array_distinct(F.transform("cs", lambda x: x["c"]))).alias("ord", "c"))
    return rows.where("name <> '' AND c <> ''").select("rec", F.concat_ws("|", "name", "c").alias("key"), "ord")


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Attach the records of one contested component in record order. A link is refused if it would join two
    anchored entities. Rows: rec, key, ord, root (null for a record without a strong key)."""
    group: dict = {}
    owner: dict = {}

    def of(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    def join(a, b):
        a, b = of(a), of(b)
        if a == b or (a in owner and b in owner):
            return
        group[b] = a
        if b in owner:
            owner[a] = owner[b]

    for r in pdf["root"].dropna().unique():
        owner[("root", int(r))] = int(r)
    pdf = pdf.sort_values(["rec", "ord"], kind="stable")
    for key in pdf["key"].drop_duplicates():
        part = pdf[pdf["key"] == key]
        loose = part.loc[part["root"].isna(), "rec"].tolist()
        roots = part["root"].dropna().unique()
        for other in loose[1:]:
            join(loose[0], other)
        if len(roots) == 1 and loose:
            join(("root", int(roots[0])), loose[0])
    recs = [int(r) for r in pdf.loc[pdf["root"].isna(), "rec"].drop_duplicates()]
    first: dict = {}
    for r in sorted(recs):
        first.setdefault(of(r), r)
    return pd.DataFrame({"rec": recs, "label": [owner.get(of(r), first[of(r)]) for r in recs]}, dtype="int64")


def resolve(claims: DataFrame) -> DataFrame:
    """(rec, cluster): cluster is the smallest rec of the entity. ``claims`` should be materialized.

    Strong keys link without doubt. A record without one is attached by name and company if those point to exactly
    one entity that has one. A component of such records with one offer goes there as a whole, in any order; with
    several offers it is replayed in record order, one component per task.
    """
    recs = claims.select("rec").distinct()
    anchored = cut(shared_key_components(strong_keys(claims), "rec", "key").select(F.col("id").alias("rec"), F.col("label").alias("root")), "roots")
    if recs.join(anchored, "rec", "left_anti").isEmpty():
        return anchored.select("rec", F.col("root").alias("cluster"))
    named = cut(name_company_keys(claims).join(anchored, "rec", "left"), "named")
    loose = named.where("root IS NULL")
    first = loose.groupBy("key").agg(F.min("rec").alias("b"))
    comp = components(loose.join(first, "key").select(F.col("rec").alias("a"), "b"))
    comp = cut(loose.select("rec").distinct().join(comp, F.col("rec") == F.col("id"), "left").select("rec", F.coalesce("label", "rec").alias("comp")), "loose")
    offers = named.where("root IS NOT NULL").groupBy("key").agg(F.min("root").alias("root"), F.max("root").alias("other")).where("root = other").select("key", F.col("root").alias("offer"))
    offered = loose.join(offers, "key").join(comp, "rec").groupBy("comp").agg(F.min("offer").alias("offer"), F.max("offer").alias("offer2"))
    plain = comp.join(offered, "comp", "left").select("rec", "comp", "offer", (F.col("offer") < F.col("offer2")).alias("contested"))
    plain = cut(plain, "offers")
    hard = plain.where("contested")
    if hard.isEmpty():
        weak = plain.select("rec", F.coalesce("offer", "comp").alias("cluster"))
    else:
        keys = loose.join(hard, "rec").select("comp", "key").distinct()
        rows = named.join(keys, "key").select("comp", "rec", "key", "ord", "root")
        done = rows.groupBy("comp").applyInPandas(lambda p: _replay(p), "rec long, label long")
        weak = plain.where("contested IS NULL OR NOT contested").select("rec", F.coalesce("offer", "comp").alias("cluster")).union(done)
    joined = recs.join(anchored, "rec", "left").join(weak, "rec", "left").select("rec", F.coalesce("root", "cluster", "rec").alias("c"))
    # the smallest record may be one that was attached
    return joined.join(joined.groupBy("c").agg(F.min("rec").alias("cluster")), "c").select("rec", "cluster")
