"""URL filter: pattern rules indexed by their rarest literal token.

A url is cut into tokens (runs of ASCII letters and digits of host and path). Each rule is filed under
one literal token that every fitting url must hold as a whole token: the one that the fewest rules hold.
The tokens of a url fetch candidate rules, and only those run their regular expression.

Native: only DataFrame functions. Up to ``INLINE_RULES`` rules the index is a constant array of hash
buckets inside the projection (no shuffle, no join). Beyond that, the tokens of distinct (host, path) pairs
are joined with the rule table, broadcast only up to ``BROADCAST_RULES`` rules.

Defined results: a null url, or one without ``://``, has an empty host and path. Without a fitting rule the
verdict is ``default`` and the rule null. Rules of equal length: the one that sorts last wins. Repeated rows
each get their result. Columns of the input that clash with the ones made here are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table

INLINE_RULES = 512
BROADCAST_RULES = 100_000
MADE = ["host", "path", "rule", "verdict"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        """On host + path; a host holds no slash, so it ends at the first one."""
        quote = lambda s: re.sub(r"([^\w])", r"\\\1", s, flags=re.ASCII) if s.isascii() else r"\Q" + s + r"\E"
        host = rf"(?:[^/]*\.)?{quote(self.host)}" if self.host else "[^/]*"
        return rf"(?s)^{host}(?=/|\z){quote(self.path)}"

    def tokens(self) -> set[str]:
        """Tokens that a fitting url holds whole: of the path only those with something after them."""
        return {t for t in re.split(r"[^A-Za-z0-9]+", self.host) if t} | set(re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", self.path))


def index(rules: list[Rule]) -> list[tuple[str | None, Rule]]:
    """Each rule with its rarest token; None if it has none and must always be tried."""
    held = Counter(t for r in rules for t in r.tokens())
    return [(min(r.tokens(), key=lambda t: (held[t], -len(t), t), default=None), r) for r in rules]


def split_url(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return ascii_lower(host), path


def _tokens() -> Column:
    return F.array_distinct(F.split(F.concat_ws(" ", "host", "path"), r"[^A-Za-z0-9]+"))


def _rule_struct(token: str | None, r: Rule) -> Column:
    fields = {"token": token or "", "regex": r.regex, "rule": r.text, "verdict": r.verdict}
    return F.struct(F.lit(len(r.text)).alias("size"), *[F.lit(v).alias(k) for k, v in fields.items()])


def _inline(indexed: list[tuple[str | None, Rule]]) -> Column:
    """The best fitting rule as struct(size, rule, verdict); the bucket of a token is found in one step."""
    n = 1 << max(1, (2 * len(indexed) - 1).bit_length())
    nothing = F.filter(F.array(_rule_struct("", Rule("", ""))), lambda _: F.lit(False))
    filed: dict[int, list[Column]] = {}
    for token, r in indexed:
        if token is not None:
            filed.setdefault(zlib.crc32(token.encode()) % n, []).append(_rule_struct(token, r))
    buckets = F.array(*[F.array(*filed[i]) if i in filed else nothing for i in range(n)])
    fetch = lambda t: F.filter(F.get(buckets, (F.crc32(t.cast("binary")) % n).cast("int")), lambda r: r["token"] == t)
    always = [_rule_struct(None, r) for token, r in indexed if token is None]
    found = F.flatten(F.transform(_tokens(), fetch))
    found = F.concat(found, F.array(*always)) if always else found
    fits = F.filter(found, lambda r: F.regexp_like(F.concat("host", "path"), r["regex"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _joined(df: DataFrame, indexed: list[tuple[str | None, Rule]]) -> DataFrame:
    spark = df.sparkSession
    rows = [(t, len(r.text), r.regex, r.text, r.verdict) for t, r in indexed if t is not None]
    rules = spark.createDataFrame(rows, "token string, size int, regex string, rule string, verdict string")
    rules = F.broadcast(rules) if len(rows) <= BROADCAST_RULES else rules.hint("shuffle_hash")
    urls = df.select("host", "path").distinct()
    best = F.max(F.struct("size", "rule", "verdict")).alias("best")
    hits = (
        urls.withColumn("token", F.explode(_tokens()))
        .join(rules, "token")
        .where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
        .groupBy("host", "path")
        .agg(best)
    )
    always = [(t, r) for t, r in indexed if t is None]
    out = df.join(hits, ["host", "path"], "left")
    return out.withColumn("best", F.greatest("best", _inline(always))) if always else out


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict of each url."""
    host, path = split_url(F.col(url))
    keep = [c for c in df.columns if c.lower() not in MADE]
    df = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    indexed = index(rules)
    df = df.withColumn("best", _inline(indexed)) if len(rules) <= INLINE_RULES else _joined(df, indexed)
    return df.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


# The rules of the registered query.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


_CASES = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{i}}}'"
    for i, r in sorted(enumerate(RULES), key=lambda x: -len(x[1].text))
)
SQL = {
    "op4_url_filter": f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, CASE {_CASES.format(*[r.text for r in RULES])} END AS rule,
  CASE {_CASES.format(*[r.verdict for r in RULES])} ELSE 'allow' END AS verdict FROM parts"""
}
