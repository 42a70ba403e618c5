"""URL block and allow rules by hashed host-suffix and path-prefix expressions.

Native DataFrame operations only. Each url's host is expanded into its label
suffixes and its path into prefixes; the expressions' short hash prefixes are
equi-joined with those of the rules, and the full digest then confirms a match.
The longest confirmed rule decides; of two rules alike in text, block wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (action, host, path) of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rule lists up to this many entries are broadcast; longer ones are shuffled.
BROADCAST_RULES = 10_000
#: Hex digits of a digest's short prefix.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url) -> tuple:
    """(host, path) columns. Null, or no ``://``: both empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    df = spark.createDataFrame([tuple(r) for r in rules], "action string, rule_host string, rule_path string")
    text = F.concat("rule_host", "rule_path")
    digest = F.sha2(text, 256)
    return df.select("action", "rule_host", "rule_path", text.alias("rule"), digest.alias("digest"), F.substring(digest, 1, SHORT).alias("short"))


def judge_urls(pages: DataFrame, rules, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages(page_id, url)``.

    One output row per input row, repeated rows included. A null url or one
    without ``://`` has an empty host and path, which no rule fits, and gets the
    default verdict with a null rule. A host that starts or ends with a dot keeps
    its empty label. Other columns of ``pages`` are ignored, whatever their names.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = sorted({r[1].count(".") + 1 for r in rules})
    lengths = sorted({len(r[2]) for r in rules})
    if not rules:
        return seen.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Only label counts and path lengths that some rule has can match.
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(ints(hosts), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    prefixes = F.transform(F.filter(ints(lengths), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        seen.select("host", "path").where("host <> ''").distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("full", F.sha2(F.concat("suffix", "prefix"), 256))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    known = rules_frame(spark, rules)
    known = F.broadcast(known) if len(rules) <= BROADCAST_RULES else known
    met = expressions.join(known, "short").where("full = digest AND suffix = rule_host AND prefix = rule_path")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("action"), F.col("rule"))).alias("won"))
    out = seen.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
judged AS (
  SELECT page_id, host, path,
    (SELECT max_by(struct_pack(r := rh || rp, v := verdict), length(rh || rp)) FROM rules
      WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS won FROM parts)
SELECT page_id, host, path, won.r AS rule, coalesce(won.v, 'allow') AS verdict FROM judged
"""
