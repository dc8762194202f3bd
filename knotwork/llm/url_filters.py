"""URL filters by prefix expressions and short hash prefixes, with DataFrame functions only.

A rule is a host and a path. It fits a URL whose host is the rule's or a subdomain of it, and whose path starts with
the rule's path; the longest rule wins. As with lists of unsafe URLs, nothing is compared as text: each URL
is expanded into all pairs of a host suffix (of as many labels as rules have) and a path prefix (of the lengths that rules have), these
expressions are joined to the rules on the first four bytes of their SHA-256, and the full
digests confirm a match. Then the longest confirmed rule decides (on equal lengths the longer
host; of equal expressions "block").

A host of very many labels gives no more suffixes than the rules have different label counts.

Skew: URLs are first reduced to distinct (host, path) pairs; rows without a host are spread over the join. The rules are broadcast only up to ``broadcast_rules``
rows; a larger list is joined by shuffling, where the expressions are first reduced to distinct ones, so that a
common suffix is one row and not one for each URL.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule; a null rule column
excludes the rule; no rule fits: rule null, verdict ``default``; an empty rule table leaves every page to
``default``. Other columns pass through; input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def url_parts(url):
    """(host, path) of a URL column; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (its host and path) and ``verdict``."""
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rules = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == "block", "block").otherwise(F.col("verdict"))).alias("last"), F.max((F.col("verdict") == "block").cast("int")).alias("blocks"))
    rules = rules.select("host", "path", F.when(F.col("blocks") == 1, "block").otherwise(F.col("last")).alias("verdict"))
    rules = rules.withColumn("rule", F.concat("host", "path")).withColumn("digest", F.sha2(F.concat_ws("\n", "host", "path"), 256))
    listed = rules.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths"), F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels")).first()
    few = listed["n"] <= broadcast_rules

    own = pages.drop("host", "path", "rule", "verdict")
    host, path = url_parts(F.col(url_col).cast("string"))
    own = own.withColumns({"host": host, "path": path})
    urls = own.where("host <> ''").select("host", "path").distinct()
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    suffixes = F.array_compact(F.array(*(F.when(labels >= n, F.substring_index("host", ".", -n)) for n in listed["labels"]))) if listed["n"] else F.array().cast("array<string>")
    lengths = F.array(*(F.lit(n) for n in listed["lengths"])) if listed["n"] else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = urls.withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(prefixes))
    pairs = pairs.withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "start"), 256))
    rule = rules.select(F.substring("digest", 1, PREFIX_DIGITS).alias("short"), F.col("digest").alias("full"), "rule", "verdict", F.length("host").alias("host_length"))
    if few:
        hits = pairs.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)).join(F.broadcast(rule), "short")
        hits = hits.where(F.col("digest") == F.col("full"))
    else:
        asked = pairs.select("digest").distinct().withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
        confirmed = asked.join(rule, "short").where(F.col("digest") == F.col("full")).select("digest", "rule", "verdict", "host_length")
        hits = pairs.join(confirmed, "digest")
    best = F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict")
    judged = hits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(best).alias("best"))
    # Rows without a host meet no rule; their key is spread so that they are no hot group.
    spread = F.when(own["host"] == "", F.xxhash64(F.col(url_col).cast("string"), F.monotonically_increasing_id())).otherwise(F.lit(0).cast("long"))
    own_keyed, judged = own.withColumn("__spread", spread), judged.withColumn("s", F.lit(0).cast("long"))
    found = own_keyed.join(judged, (own_keyed["host"] == judged["h"]) & (own_keyed["path"] == judged["p"]) & (own_keyed["__spread"] == judged["s"]), "left")
    return found.select(*own.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
