"""URL filters indexed by the rarest literal token of each rule (operator 6).

Each rule is a regular expression over a url's host and path. Of the tokens
that any url it fits must hold, the one that the fewest urls of the corpus
hold indexes it; a url's tokens fetch candidate rules, and only those run
their expression. Rules without such a token are tried on every url.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

TOKEN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """name: what results call it; host and path rules, unlike patterns, are explicit and the longest one wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    explicit: bool


def site(verdict: str, host: str, path: str = "") -> Rule:
    """Fits a host and its subdomains where the path starts with that of the rule.

    All tokens of the host are whole in a url; one at the end of the path may go on.
    """
    whole = [m[0] for m in TOKEN.finditer(path) if m.end() < len(path)]
    return Rule(host + path, verdict, rf"(?s)\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path) if path else '(?=/|\\Z)'}", (*TOKEN.findall(host), *whole), True)


def word(verdict: str, name: str) -> Rule:
    """Fits where the name stands between dots, hyphens or slashes."""
    return Rule(name, verdict, rf"(?s)(?:\A|[./_-]){re.escape(name)}(?:[./_-]|\Z)", tuple(TOKEN.findall(name)), False)


#: The host and path rules, and words of the hosts of pills, bets, spam and tracking.
SITES = (
    site("block", "com", "/en/"),
    site("allow", "example.com", "/en/7"),
    site("allow", "net", "/de/"),
    site("block", "example.net", "/de/8"),
    site("block", "org", "/es/"),
)
WORDS = tuple(
    word("block", w)
    for w in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm", "ads", "adult", "adserver", "bets", "casino", "doubleclick", "pills", "poker", "porn", "spam", "tracker", "viagra", "xxx")
)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleIndex:
    def __init__(self, rules: list[Rule], holders: dict[str, int]):
        self.rules = [(r, re.compile(r.pattern)) for r in rules]
        self.always: list[int] = []
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for k, rule in enumerate(rules):
            if rule.tokens:
                self.by_token[min(rule.tokens, key=lambda t: (holders.get(t, 0), t))].append(k)
            else:
                self.always.append(k)

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None]:
        """The explicit rule that wins, the verdict, and the pattern that gave it if no rule did."""
        url = host + path
        candidates = {k for t in set(TOKEN.findall(url)) for k in self.by_token.get(t, ())}
        fits = [self.rules[k][0] for k in sorted(candidates.union(self.always)) if self.rules[k][1].search(url)]
        if sites := [r for r in fits if r.explicit]:
            best = max(sites, key=lambda r: len(r.name))
            return best.name, best.verdict, None
        for r in fits:
            return None, r.verdict, r.name
        return None, "allow", None


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITES + WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for each row of pages (page_id, url).

    The longest explicit rule that fits gives the verdict; else the first
    pattern that fits does; else a url is allowed. Null urls, and those
    without ://, have an empty host and path. Rows that share or lack a
    page_id are judged one by one; other columns are ignored; an empty table
    gives an empty result. The rules are a parameter and travel with the tasks.
    """
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    known = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({TOKEN.pattern})"), 1))
    held = parts.select(F.explode(F.filter(tokens, lambda t: t.isin(known))).alias("token")).groupBy("token").count()
    index = RuleIndex(list(rules), {r["token"]: r["count"] for r in held.collect()})  # as many rows as the rules have tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [index.judge(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            more = [pa.array([j[k] for j in judged], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _oracle() -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"

    @dataclass
    class Split:
        host: str
        path: str
        verdict: str

    rules = sorted((Split(r.name.partition("/")[0], "/" + r.name.partition("/")[2], r.verdict) for r in SITES), key=lambda r: -len(r.host + r.path))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.host}{r.path}'" for r in rules)
    said = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in rules)
    first = " ".join(f"WHEN regexp_matches(host || path, '(?s)(^|[./_-]){w.name}([./_-]|$)') THEN '{w.name}'" for w in WORDS)
    return f"""
WITH split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE {rule} END AS rule, CASE {said} END AS said, CASE {first} END AS word FROM split
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN word END AS pattern
FROM ruled
"""


ORACLE = _oracle()
