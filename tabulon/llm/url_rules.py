"""URL filter: pattern rules indexed by their rarest literal token; a URL's tokens fetch the only rules that run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read_table

#: (action, host, path): fixed values of the query.
FIXED_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The method's own patterns, used where no fixed rule fits; * stands for any run of characters.
PATTERNS = [("block", "spam-farm.*", ""), ("block", "link-farm.*", ""), ("block", "*", "/casino/"), ("block", "*", "/viagra/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first "://" up to / ? # or the end, A-Z lower-cased; path from there up to ? # or the end.

    Null or no "://": both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _regex(text: str) -> str:
    return "".join("[\\s\\S]*" if c == "*" else c if c.isalnum() else "\\" + c for c in text)


def compile_rule(action: str, host: str, path: str) -> dict:
    """A rule as a regular expression over host + path, with the literal tokens that any URL it fits must hold.

    A token counts only if the rule itself bounds it on both sides, so that it is a whole token of the URL."""
    tokens = set()
    for text in ("." + host + ("." if host and path[:1] == "/" else "*"), path + "*"):
        tokens |= set(re.findall(r"(?<![*a-z0-9])[a-z0-9]+(?![*a-z0-9])", text.lower()))
    prefix = "^[\\s\\S]*" if host.startswith("*") else "^(?:[^/]*\\.)?"
    return {"action": action, "rule": host + path, "regex": prefix + _regex(host.lstrip("*")) + ("(?=/)" if path[:1] == "/" and not host.startswith("*") else "") + _regex(path), "tokens": sorted(tokens)}


def url_tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(key), "[^a-z0-9]+"), lambda t: t != ""))


def _struct(rule: dict) -> Column:
    return F.struct(F.lit(len(rule["rule"])).alias("size"), F.lit(rule["rule"]).alias("rule"), F.lit(rule["action"]).alias("action"), F.lit(rule["regex"]).alias("regex"))


def index_rules(urls: DataFrame, key: str, rules: list[tuple[str, str, str]]) -> list[dict]:
    """Compiled rules, each with the token under which it is filed: its rarest over all the URLs (None: it has none)."""
    compiled = [compile_rule(*r) for r in rules]
    wanted = sorted({t for r in compiled for t in r["tokens"]})
    counts: dict[str, int] = {}
    if wanted:
        hits = F.array_intersect(url_tokens(F.col(key)), F.array(*map(F.lit, wanted)))
        counts = {t: n for t, n in urls.select(F.explode(hits).alias("t")).groupBy("t").count().collect()}  # one row per rule token at most
    for r in compiled:
        r["token"] = min(r["tokens"], key=lambda t: (counts.get(t, 0), t), default=None)
    return compiled


def best_rule(urls: DataFrame, key: str, rules: list[tuple[str, str, str]], out: str, max_inline: int = 500) -> DataFrame:
    """Adds out: struct(rule, action) of the longest rule that fits the key column (null: none); ties go to the later text.

    Up to max_inline rules, the index is a constant of the projection and nothing is shuffled. Beyond it, distinct keys
    meet the index in a hash join on their tokens and the result is joined back."""
    compiled = index_rules(urls, key, rules)
    always = [r for r in compiled if r["token"] is None]
    empty = F.filter(F.array(_struct(compile_rule("allow", "x", "/"))), lambda r: F.lit(False))
    spark = urls.sparkSession
    fits = lambda r: F.regexp_like(F.col(key), r["regex"])
    if len(compiled) <= max_inline:
        by_token: dict[str, list[dict]] = {}
        for r in compiled:
            if r["token"] is not None:
                by_token.setdefault(r["token"], []).append(r)
        found = [F.array(*map(_struct, always))] if always else []
        for token, group in sorted(by_token.items()):
            found.append(F.when(F.array_contains("_tokens", token), F.array(*map(_struct, group))).otherwise(empty))
        fetched = F.concat(*found) if found else empty
        best = F.array_max(F.filter(fetched, fits))
        return urls.withColumn("_tokens", url_tokens(F.col(key))).withColumn(out, best).withColumn(out, F.when(F.col(out).isNotNull(), F.struct(F.col(out)["rule"].alias("rule"), F.col(out)["action"].alias("action")))).drop("_tokens")
    index = spark.createDataFrame([(r["token"], len(r["rule"]), r["rule"], r["action"], r["regex"]) for r in compiled], "token string, size int, rule string, action string, regex string")
    keys = urls.select(F.col(key).alias("_k")).distinct()
    tokens = keys.select("_k", F.explode(url_tokens(F.col("_k"))).alias("token"))
    if always:
        tokens = tokens.union(keys.select("_k", F.lit("*")))
    hits = tokens.join(index.fillna({"token": "*"}), "token").where(F.regexp_like(F.col("_k"), F.col("regex")))
    best = hits.groupBy("_k").agg(F.max(F.struct("size", "rule", "action")).alias("_b"))
    best = best.select("_k", F.struct(F.col("_b.rule").alias("rule"), F.col("_b.action").alias("action")).alias(out))
    return urls.join(best, urls[key] == best["_k"], "left").drop("_k")


def judge_urls(pages: DataFrame, rules=FIXED_RULES, patterns=PATTERNS, url: str = "url", default: str = "allow", max_inline: int = 500) -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    The longest of the rules that fits decides; else the longest of the patterns; else default. Null, empty and odd URLs get
    empty host and path and the default; very long ones are judged whole. Repeated rows stay, and so do all other columns,
    whatever their names; columns of these four names are replaced."""
    new = ("host", "path", "rule", "verdict")
    others = [c for c in pages.columns if c.lower() not in new]
    host, path = host_and_path(F.col(f"`{url}`"))
    out = pages.select(F.struct(*[f"`{c}`" for c in others]).alias("others"), host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))
    out = best_rule(out, "key", rules, "fixed", max_inline)
    out = best_rule(out, "key", patterns, "own", max_inline)
    verdict = F.coalesce("fixed.action", "own.action", F.lit(default))
    return out.select(*[F.col("others").getField(c).alias(c) for c in others], "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), k AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM k
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '^([^/]*\.)?(spam-farm|link-farm)\.') THEN 'block'
  WHEN starts_with(path, '/casino/') OR starts_with(path, '/viagra/') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""
