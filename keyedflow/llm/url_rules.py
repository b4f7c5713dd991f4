"""URL rules by hash prefix: the way safe-browsing lists are looked up.

A rule is a host and a path. A URL is expanded into every suffix of its host and every prefix
of its path that is as long as some rule's path; each expression's digest meets the rules'
by its first 32 bits in an equi-join, and the full digest confirms. Of the rules that fit, the
longest decides. Only distinct hosts and paths are expanded.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the
default verdict. An empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import BROADCAST_BYTES, table

#: The rules of the query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More than a rule takes with its digest, for the size check before it is broadcast.
RULE_BYTES = 512


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host and path."""
    after = F.expr(f"substr(`{url}`, char_length(substring_index(`{url}`, '://', 1)) + 4)")
    rest = F.when(F.col(url).contains("://"), after).otherwise("")
    tail = F.expr("substr(_rest, char_length(_head) + 1)")
    return (
        df.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("_head", F.regexp_extract("_rest", "(?s)^[^/?#]*", 0))
        .withColumn("path", F.regexp_extract(tail, "(?s)^[^?#]*", 0))
        .withColumn("host", F.translate("_head", UPPER, LOWER))
        .drop("_rest", "_head")
    )


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", bits: int = 32) -> DataFrame:
    """``df`` with host, path, rule and verdict; ``rules`` has verdict, host, path.

    Of rules that say the same host and path, the one whose verdict sorts first counts.
    """
    carried = [f"_c{i}" for i in range(len(df.columns))]
    urls = split_url(df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, carried)], F.col(url).alias("_url")), "_url")

    digest = F.sha2(F.concat_ws("\n", F.col("_suffix"), F.col("_prefix")), 256)
    prefix = F.left(F.col("_digest"), F.lit(bits // 4))
    keyed = (
        rules.groupBy(F.col("host").alias("_suffix"), F.col("path").alias("_prefix"))
        .agg(F.min("verdict").alias("_verdict"), F.count(F.lit(1)).alias("_same"))
        .withColumn("_digest", digest)
        .withColumn("_short", prefix)
        .select("_short", "_digest", "_verdict", F.concat("_suffix", "_prefix").alias("_rule"))
    )
    known = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    if known.n * RULE_BYTES <= BROADCAST_BYTES:
        keyed = F.broadcast(keyed)

    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(known.lengths)]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.left(F.col("path"), n))
    expressions = (
        pairs.withColumn("_suffix", F.explode(suffixes))
        .withColumn("_prefix", F.explode(prefixes))
        .withColumn("_digest", digest)
        .withColumn("_short", prefix)
    )
    rank = F.struct(F.char_length("_rule").alias("n"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
    confirmed = expressions.join(keyed.withColumnRenamed("_digest", "_full"), "_short").where("_digest = _full")
    best = confirmed.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(df.columns, carried) if c not in ("host", "path", "rule", "verdict")],
        "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


def op10_url_rules(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS head FROM u),
p AS (
  SELECT page_id, translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(head) + 1), '^[^?#]*') AS path FROM h),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, host, path, r.h || r.p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
