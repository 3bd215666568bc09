"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every distinct (host, path) is expanded into the expressions `suffix/prefix` a rule could have:
each label suffix of the host with each path prefix whose length some rule path has.  The
expressions meet the rules in an equi-join on the first four bytes of SHA-256; survivors must agree
on the whole digest.  The longest rule that fits wins.

Only DataFrame functions run.  The work of one URL is bounded by its label count times the number of
different rule-path lengths, whatever the number of rules; the rules are broadcast only when
a count proves them few, and otherwise meet the expressions in a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this count are broadcast (under 20 MB); more are joined by shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; ASCII letters in lower case."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("__url")))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("__url")))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path; clashing columns of pages are replaced."""
    kept = pages.drop("host", "path").withColumn("__url", F.col(url))
    return kept.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))}).drop("__url")


def hashed(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages plus host, path, rule and verdict.

    rules: (host, path, verdict).  A rule fits its host and all subdomains where the URL's path starts
    with the rule's path.  Precedence: longest host and path together, then longest host, then `block`.
    Null URLs and URLs without `://` have empty host and path and get the default verdict (unless a
    rule has an empty host and path).  Repeated pages each keep their row; repeated rules count once;
    rules with null parts never fit; an empty rules table gives every page the default.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().sort(F.length("path")).collect()]
    pages = with_host_path(pages, url).drop("rule", "verdict")
    if not lengths:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = rules.select(F.concat("host", F.lit("\n"), "path").alias("__e"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("__hl"))
    keyed = keyed.withColumn("__full", hashed(F.col("__e"))).withColumn("__short", F.substring("__full", 1, 8)).drop("__e")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.split(F.lit(",".join(map(str, lengths))), ",").cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(cuts, lambda n: F.concat(h, F.lit("\n"), F.substring("path", F.lit(1), n)))))
    distinct = pages.groupBy("host", "path").agg(F.lit(1).alias("__one")).drop("__one")
    tried = distinct.select("host", "path", F.explode(F.array_distinct(expressions)).alias("__e"))
    tried = tried.select("host", "path", hashed(F.col("__e")).alias("__tried")).withColumn("__short", F.substring("__tried", 1, 8))
    fits = tried.join(keyed, "__short").where("__tried = __full")
    best = F.max(F.struct(F.length("rule").alias("n"), F.col("__hl").alias("h"), (F.col("verdict") == "block").alias("b"), F.col("rule").alias("r"), F.col("verdict").alias("v")))
    won = fits.groupBy("host", "path").agg(best.alias("w")).select("host", "path", F.col("w.r").alias("rule"), F.col("w.v").alias("verdict"))
    return pages.join(won, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
