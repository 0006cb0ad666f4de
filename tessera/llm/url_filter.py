"""URL filters: pattern rules indexed by their rarest literal token (DataFrame functions only).

A rule is a regular expression over ``host + path`` with the literal tokens that any match must hold. Rules are a
table, of any length. Each is filed under that one of its tokens which the fewest URLs hold. The tokens of a URL
fetch candidate rules by an equality join on that token, and only the candidates' expressions run. Spark broadcasts
the index where it is small (its size is known to the planner) and shuffles both sides where it is not; tokens that
stand in very many URLs are the last that a rule is filed under.

A rule may have no token, or none that is a whole run of lower-case letters and digits: it is tried on every URL, filed
under each of ``SALTS`` marks of which every URL has one. Rules may share a name; equal ones count once.

Null URLs, and those without ``://``, have an empty host and path: no rule fits, the verdict is ``allow``.
Repeated rows are judged each for itself, whatever their ids. An empty table gives an empty result; further columns
are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

TOKEN = "[a-z0-9]+"
#: Marks that split the URLs evenly where rules without tokens are tried on all of them.
SALTS = 64
RULE = "name string, pattern string, verdict string, rank int, tokens array<string>"


@dataclass(frozen=True)
class UrlRule:
    """``name`` is reported; ``pattern`` is searched in host + path; ``rank``: the highest fitting rule wins."""

    name: str
    pattern: str
    verdict: str
    rank: int
    tokens: tuple[str, ...]


def host_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A rule that fits a host with all subdomains where the path starts with ``path``; longer ones win."""
    whole = host + path
    # The last token of the path may go on in the URL, so only tokens that end within the rule are literal.
    tokens = re.findall(TOKEN, host.lower()) + [t for t in re.findall(f"({TOKEN})[^a-z0-9]", path)]
    return UrlRule(whole, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, 1000 + len(whole), tuple(tokens))


def word_rule(name: str, *tokens: str) -> UrlRule:
    """A block rule for URLs that hold the tokens next to each other, split by anything but letters and digits."""
    return UrlRule(name, "(?i)(^|[^a-z0-9])" + "[^a-z0-9]+".join(tokens) + "([^a-z0-9]|$)", "block", 0, tokens)


#: The rules of the contract.
HOST_RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)

#: Unwanted words in URLs that no host rule decides.
WORD_RULES = tuple(
    word_rule("-".join(words), *words)
    for words in (
        ("spam", "farm"), ("cheap", "pills"), ("free", "casino"), ("online", "casino"), ("adult", "chat"), ("click", "bait"),
        ("link", "farm"), ("payday", "loan"), ("payday", "loans"), ("replica", "watches"), ("hot", "singles"), ("crypto", "giveaway"),
        ("porn",), ("xxx",), ("viagra",), ("casino",), ("warez",), ("malware",), ("phishing",), ("doorway", "page"),
    )
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules: tuple[UrlRule, ...] = HOST_RULES + WORD_RULES) -> DataFrame:
    """The rules as a table of ``RULE``; longer lists are read from a file with these columns."""
    row = lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"), F.lit(r.rank).alias("rank"), F.array(*map(F.lit, r.tokens)).alias("tokens"))
    return spark.range(1).select(F.inline(F.array(*map(row, rules))))


def filed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``token, name, pattern, verdict, rank``: each rule under its token that the fewest of all URLs hold (ties: by token).

    A rule is told by all its columns, not by its name. One without a token is filed under every mark.
    """
    literal = F.coalesce(F.filter("tokens", lambda t: t.isNotNull() & F.regexp_like(t, F.lit(f"^{TOKEN}$"))), F.array().cast("array<string>"))
    whole = ("name", "pattern", "verdict", "rank")
    told = rules.select(*whole, literal.alias("tokens")).distinct()
    by_token = told.select(*whole, "tokens", F.explode("tokens").alias("token"))
    held = urls.select(F.explode(F.array_distinct("tokens")).alias("token")).join(by_token.select("token").distinct(), "token", "left_semi")
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    least = by_token.join(counts, "token", "left").groupBy(*whole, "tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    marks = F.array(*[F.lit(f"#{i}") for i in range(SALTS)])
    everywhere = told.filter(F.size("tokens") == 0).select(F.explode(marks).alias("token"), *whole)
    return least.select(F.col("least.token").alias("token"), *whole).unionByName(everywhere)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: DataFrame | None = None) -> DataFrame:
    """``id_col``, host, path, rule (the best fitting one), its rank, verdict and number of candidates, a row for each page."""
    host, path = url_parts(F.col("_url"))
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    site = F.concat("host", "path")
    urls = urls.withColumn("tokens", F.regexp_extract_all(ascii_lower(site), F.lit(f"({TOKEN})"), 1))
    index = filed(rules_table(pages.sparkSession) if rules is None else rules, urls)
    # One row for each token of a URL and one for its mark; the row's number brings them together again.
    mark = F.concat(F.lit("#"), F.pmod("row", F.lit(SALTS)).cast("string"))
    tokens = F.concat(F.array(mark), F.array_distinct("tokens"))
    asked = urls.withColumn("row", F.monotonically_increasing_id()).select("row", "_id", "host", "path", F.posexplode(tokens).alias("at", "token"))
    met = asked.join(index, "token", "left").filter(F.col("pattern").isNotNull() | (F.col("at") == 0))
    fits = F.col("pattern").isNotNull() & F.regexp_like(site, F.col("pattern"))
    best = F.max(F.when(fits, F.struct("rank", "name", "verdict"))).alias("best")
    one = met.groupBy("row", "_id", "host", "path").agg(best, F.count("pattern").cast("int").alias("n_candidates"))
    return one.select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.rank", F.lit(-1)).alias("rank"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), "n_candidates",
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page. ``rule`` names host rules alone; ``pattern`` names the word rule that blocked."""
    out = filter_urls(table(spark, sf_dir, "pages"))
    by_host = F.col("rank") >= 1000
    return out.select("page_id", "host", "path", F.when(by_host, F.col("rule")).alias("rule"), "verdict", F.when(~by_host, F.col("rule")).alias("pattern"))


def _sql_rules() -> str:
    hosts = "".join(f"('{r.name}', '{r.pattern}', '{r.verdict}', {r.rank}), " for r in HOST_RULES + WORD_RULES)
    return hosts.rstrip(", ")


OP4_SQL = rf"""
WITH rules(name, pattern, verdict, rank) AS (VALUES {_sql_rules()}),
parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
sites AS (
  SELECT row_number() OVER () AS n, page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
best AS (
  SELECT n, max(row(rank, name, verdict)) AS b FROM sites JOIN rules ON regexp_matches(host || path, pattern) GROUP BY n)
SELECT page_id, host, path, CASE WHEN b[1] >= 1000 THEN b[2] END AS rule, coalesce(b[3], 'allow') AS verdict,
  CASE WHEN b[1] < 1000 THEN b[2] END AS pattern
FROM sites LEFT JOIN best USING (n)
"""
