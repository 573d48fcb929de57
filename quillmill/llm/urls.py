"""URL rules: host-suffix and path-prefix expressions, an equi-join on short digests, then rule precedence.

Each URL is expanded into expressions ``host suffix + path prefix`` (prefixes end at a slash). The first four
bytes of an expression's SHA-256 join it to the rules; the whole digest and the rule's full path confirm the hit.
The longest rule (host plus path, in characters) wins; of two equally long ones ``block`` wins, then the smaller text.

Defined cases: a null URL or one without ``://`` has an empty host and path and gets the default verdict; an empty
path matches no rule whose path begins with ``/``; a rule with a null part never fires; an empty rule table gives
everyone the default; repeated rows each keep their own result; other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import table

#: Rules of the registered query: (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Rule tables up to this many rows are broadcast; larger ones are joined by shuffling both sides.
BROADCAST_RULES = 100_000
#: Copies of a large rule table, so that a frequent expression such as ``com/`` spreads over this many tasks.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(path: Column) -> Column:
    """A path up to its last slash: the part of a rule's path that expressions can equal."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def expressions(host: Column, path: Column, max_labels: int, max_slashes: int) -> Column:
    """All host suffixes times all path prefixes that end at a slash (or are empty).

    ``max_labels`` and ``max_slashes`` are the largest found among the rules: deeper expressions equal no rule.
    """
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    n_hosts = F.least(F.size(labels), F.lit(max_labels))
    hosts = F.when(
        n_hosts > 0,
        F.transform(F.sequence(F.lit(1), n_hosts), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")),
    ).otherwise(F.array().cast("array<string>"))
    n_paths = F.least(F.size(parts) - 1, F.lit(max_slashes))
    paths = F.transform(
        F.sequence(F.lit(0), n_paths),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\n"), p))))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``pages(key, url)`` judged by ``rules(host, path, verdict)`` -> key, host, path, rule, verdict."""
    clean = rules.select(
        _ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).dropna()
    clean = (
        clean.withColumn("digest", F.sha2(F.concat("r_host", F.lit("\n"), _folder(F.col("r_path"))), 256))
        .withColumn("short", F.substring("digest", 1, 8))
        .withColumn("rule", F.concat("r_host", "r_path"))
    )
    seen = clean.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("r_path", "/")) - 1).alias("slashes"),
    ).first()
    urls = pages.select(
        F.col(key).alias("key_"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.monotonically_increasing_id().alias("row_"),
    )
    wide = urls.withColumn(
        "expr", F.explode_outer(expressions(F.col("host"), F.col("path"), seen["labels"] or 0, seen["slashes"] or 0))
    ).withColumn("x_digest", F.sha2("expr", 256))
    wide = wide.withColumn("x_short", F.substring("x_digest", 1, 8))
    match = F.col("x_short") == F.col("short")
    if seen["n"] <= BROADCAST_RULES:
        hits = wide.join(F.broadcast(clean), match, "left")
    else:
        wide = wide.withColumn("salt", F.pmod(F.col("row_"), F.lit(SALTS)).cast("int"))
        copies = clean.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = wide.join(copies.hint("shuffle_hash"), match & (F.col("salt") == F.col("r_salt")), "left")
    fits = (F.col("x_digest") == F.col("digest")) & F.startswith(F.col("path"), F.col("r_path"))
    best = F.struct(
        (-F.length("rule")).alias("n"), (F.col("r_verdict") != "block").alias("b"), F.col("rule"), F.col("r_verdict")
    )
    return (
        hits.groupBy("row_", "key_", "host", "path")
        .agg(F.min(F.when(fits, best)).alias("best"))
        .select(
            F.col("key_").alias(key),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
        )
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP10_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
n AS (SELECT row_number() OVER () AS rid, * FROM u),
j AS (
  SELECT n.*, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC NULLS LAST, r_host || r_path) AS k
  FROM n LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM j WHERE k = 1
"""
