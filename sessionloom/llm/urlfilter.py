"""URL filter: rules found through the rarest literal token, in DataFrame operations only.

A rule is a host and a path prefix; it fits the host and its subdomains. Each rule is indexed by that token of its host and path
which the fewest rules and common URL words share. The tokens of a distinct URL fetch candidate rules
by an equi-join, and only for those does the rule's regular expression run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9_]+"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_/])", r"\\$1")


def indexed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their text, length, regular expression and rarest token.

    Host tokens fit whole labels; the last token of a path may go on in the URL, so it serves only if a non-token
    character ends it.
    """
    rules = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"), F.coalesce("path", F.lit("/")).alias("rule_path"), "verdict").distinct()
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path"))
    # a host has no slash, so host and path can stand next to each other
    pattern = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(F.col("rule_host")), F.lit(r"(?=/|\z)"), quoted(F.col("rule_path")))
    ended = F.regexp_replace("rule_path", TOKEN + "$", "")
    tokens = F.array_distinct(F.concat(F.regexp_extract_all("rule_host", F.lit(TOKEN), F.lit(0)), F.regexp_extract_all(ended, F.lit(TOKEN), F.lit(0))))
    # a rule without a token stands under the empty one, which every URL has
    each = rules.withColumn("pattern", pattern).withColumn("token", F.explode(F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("")))))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("often")).withColumnRenamed("token", "of_token")
    return (
        each.join(often, F.col("token") == F.col("of_token"))
        .groupBy("rule", "verdict", "pattern")
        .agg(F.min_by("token", F.struct("often", -F.length("token"), "token")).alias("token"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows' own columns and host, path, rule, verdict by the longest fitting rule.

    Takes ``url``; null, or without ``://``, has an empty host and path, which no rule fits. Where none fits, rule
    is null and the verdict is ``default``. Of rules of one length ``block`` comes first, then the least text.
    Every distinct URL is judged once and all rows that have it share the outcome; input columns named
    host, path, rule or verdict are replaced.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*keep)
    urls = rows.select(F.col("url").alias("of_url")).filter("of_url is not null").distinct()
    index = indexed_rules(rules)
    parsed = urls.withColumn("line", F.concat(url_host(F.col("of_url")), url_path(F.col("of_url"))))
    probes = parsed.withColumn("url_token", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))))))
    fits = probes.join(index, F.col("url_token") == F.col("token")).filter(F.rlike("line", F.col("pattern")))
    best = fits.groupBy("of_url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("verdict") == "block", "rule")).alias("best"))
    judged = rows.join(best, F.col("url") == F.col("of_url"), "left")
    return judged.select(*keep, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
