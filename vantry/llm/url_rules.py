"""URL filters: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_BOUND = 200_000  # rules that may be broadcast; a longer list is joined by shuffle
TOKEN = r"[^a-z0-9]+"
_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """A regular expression over ``host + path`` and the whole tokens any match must hold."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    priority: int


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with its subdomains, and a prefix of the path; the longest rule wins."""
    name, host = host + path, host.translate(_SMALL)  # hosts of urls are in small letters
    whole = [t for t in re.split(TOKEN, host) if t]
    # the last token of the prefix may go on in the url unless a separator ends it
    inner = re.split(TOKEN, path.translate(_SMALL))
    whole += [t for t in inner[:-1] if t]
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}(?={re.escape(path)})", tuple(whole), 1_000 + len(host + path))


def word_rule(verdict: str, word: str) -> Rule:
    """A token anywhere in host or path."""
    return Rule(f"*{word}*", verdict, rf"(?<![a-z0-9]){word}(?![a-z0-9])", (word,), 1)


RULES = [
    prefix_rule("allow", "org", "/"),
    prefix_rule("block", "example.org", "/es/"),
    prefix_rule("block", "example.org", "/en/1"),
    prefix_rule("allow", "com", "/fr/"),
    prefix_rule("block", "com", "/de/"),
]
# Words of pages that hold no article (chosen for this operator).
WORD_RULES = [word_rule("block", w) for w in (
    "adserver", "banner", "casino", "checkout", "doubleclick", "gambling", "login", "porn", "signin", "signup", "tracker", "xxx")]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(whole, r"://([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"://[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def index(rules: list[Rule], tokens: dict[str, int]) -> list[tuple]:
    """(token, name, verdict, pattern, priority), each rule under its rarest literal token.

    ``tokens`` has the number of urls that hold each literal. A rule without a whole
    literal token is kept under the empty token, which every url has.
    """
    rarest = lambda r: min(r.literals, key=lambda t: (tokens.get(t, 0), t), default="")
    return [(rarest(r), r.name, r.verdict, r.pattern, r.priority) for r in rules]


def judge(pages: DataFrame, rules: list[Rule] | None = None, otherwise: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict on every url: (key, host, path, rule, verdict, matched).

    Each distinct host and path is judged once and joined back. It is cut into tokens. A first pass counts, for the literals of the
    rules alone, how many urls hold each; every rule is filed under its rarest one.
    The tokens of a url fetch candidate rules by an equi-join with that index (one
    row per rule: at most ``RULE_BOUND`` are broadcast, more are joined by shuffle),
    and only the fetched pairs run a regular expression. Of the rules that match, the
    one of highest priority decides, equal ones by name. ``rule`` names it if it is a
    host and path rule, ``matched`` names any.

    Null or empty urls, and those without ``://``, have empty parts and the default
    verdict; repeated rows are judged one by one; an empty table gives an empty
    result; other columns are left out.
    """
    rules = [*RULES, *WORD_RULES] if rules is None else rules
    spark = pages.sparkSession
    host, path = parts(F.col(url))
    split = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    text = F.concat("host", _lower(F.col("path")))
    tokens = F.array_distinct(F.concat(F.split(text, TOKEN), F.array(F.lit(""))))
    literals = sorted({t for r in rules for t in r.literals})
    held = split.select("host", "path").select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, literals)) if literals else tokens)).alias("t"))
    counted = {r.t: r.n for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()} if literals else {}
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("token", T.StringType()), ("name", T.StringType()), ("verdict", T.StringType()), ("pattern", T.StringType()), ("priority", T.IntegerType()))])
    table = spark.createDataFrame(index(rules, counted), schema)
    if len(rules) <= RULE_BOUND:
        table = F.broadcast(table)
    # the path keeps its letters, and its rules are case-sensitive: tokens only fetch
    places = split.select("host", "path").distinct()
    fetched = places.select("host", "path", F.explode(tokens).alias("token")).join(table, "token")
    best = (
        fetched.where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
        .groupBy("host", "path").agg(F.min(F.struct((-F.col("priority")).alias("p"), "name", "verdict")).alias("b"))
    )
    return split.join(best, ["host", "path"], "left").select(
        F.col("_key").alias(key), "host", "path",
        F.when(F.col("b.p") <= -1_000, F.col("b.name")).alias("rule"),
        F.coalesce("b.verdict", F.lit(otherwise)).alias("verdict"),
        F.col("b.name").alias("matched"),
    )


ORACLE = r"""
WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT v.host, v.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM v) v JOIN rules r
    ON (v.host = r.host OR ends_with(v.host, '.' || r.host)) AND starts_with(v.path, r.path) GROUP BY v.host, v.path),
word AS (
  SELECT host, path, min('*' || w || '*') AS matched FROM (
    SELECT DISTINCT host, path, unnest({words}) AS w FROM v)
  WHERE regexp_matches(host || path, '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)') GROUP BY host, path)
SELECT page_id, host, path, fit.rule, CASE WHEN fit.rule IS NOT NULL THEN fit.verdict WHEN matched IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(fit.rule, matched) AS matched
FROM v LEFT JOIN fit USING (host, path) LEFT JOIN word USING (host, path)
""".replace("{words}", str([w.literals[0] for w in WORD_RULES]))
