"""URL filters: host suffixes and path prefixes of each URL, joined with rules on short hash prefixes, then confirmed in full.

A URL's expressions are every suffix of its host at a label border with every prefix of its path that is as long as some rule's
path. Expressions meet rules by the first 32 bits of their SHA-256; the whole digest then confirms, and of a URL's rules the
longest wins (then the longer host, then block). Equal URLs are judged once. Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

#: Rules that may be broadcast (under 200 bytes each); more are shuffled.
BROADCAST_RULES = 100_000

#: The rules of the query: verdict, host and path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _digest(host, path):
    return F.sha2(F.concat(host, path), 256)


def _short(digest):
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each URL by rules (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.

    Returns id_col, host, path, rule (host and path of the rule that wins; null if none fits) and verdict (the rule's, else
    default), one row per row of pages. Host: what follows the first :// up to /, ?, # or the end, A-Z lower-cased; path: from
    there up to ?, # or the end; both empty for a null or one without ://. Rules with a null and repeated rules count for
    nothing more; of equal rules with both verdicts, block wins. An empty table gives no rows, and no rules give the default.
    The distinct lengths of the rules' paths reach the driver: no more numbers than the longest path has characters.
    """
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    urls = pages.select(F.col(id_col).alias("__id"), host.alias("__host"), path.alias("__path"))
    # a path is empty or starts with /, which no host holds, so the two in a row tell themselves apart
    urls = urls.withColumn("__url", F.unhex(F.sha2(F.concat("__host", "__path"), 256)))

    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.select(F.col("verdict").alias("__verdict"), "host", "path", F.length("path").alias("__long")).groupBy("host", "path", "__long").agg(F.max("__verdict").alias("__verdict"))
    rules = rules.withColumn("__digest", _digest(F.col("host"), F.concat(F.lit("\n"), F.col("path")))).withColumn("__short", _short(F.col("__digest")))
    rules = rules.select("__short", "__digest", "__verdict", F.concat("host", "path").alias("__rule"), F.length("host").alias("__host_long"))
    lengths = sorted(r[0] for r in rules.select((F.length("__rule") - F.col("__host_long")).alias("n")).distinct().collect())

    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("__path")), lambda n: F.substring(F.col("__path"), F.lit(1), n)) if lengths else F.array().cast("array<string>")
    asked = urls.dropDuplicates(["__url"]).withColumn("__suffix", F.explode(F.array_distinct(suffixes))).withColumn("__prefix", F.explode(prefixes))
    asked = asked.select("__url", _digest(F.col("__suffix"), F.concat(F.lit("\n"), F.col("__prefix"))).alias("__full")).withColumn("__first", _short(F.col("__full")))
    # the join's only key is the short prefix; of equal length, digests that start with each other are equal
    hits = asked.join(small(rules, BROADCAST_RULES), (F.col("__first") == F.col("__short")) & F.startswith("__full", F.col("__digest")))
    best = hits.groupBy(F.col("__url").alias("__hit")).agg(F.max(F.struct(F.length("__rule").alias("a"), F.col("__host_long").alias("b"), F.col("__verdict").alias("verdict"), F.col("__rule").alias("rule"))).alias("w"))
    out = urls.join(best, F.col("__url") == F.col("__hit"), "left")
    return out.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("w.rule").alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict"))
