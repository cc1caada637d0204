"""URL filters: host-suffix and path-prefix expressions, equi-joined with rules on short hash prefixes.

A rule (host, path, verdict) fits a URL if the URL's host is the rule's host or a subdomain of it and the URL's path
starts with the rule's path. Each URL is expanded into the expressions host suffix + path prefix that rules could
have: suffixes of at most as many labels as any rule's host, prefixes of the lengths that rules' paths have. An
expression is hashed with SHA-256; its first PREFIX_HEX digits alone are the join key, and of what meets by them only
those of equal whole digests are matches.
Of the rules that fit, the longest wins; of equally long ones the one with the longer host, then `allow`.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: what follows up to `?`,
`#` or the end. A null URL, or one without `://`, has an empty host and path. Where no rule fits, rule is null and
the verdict is the default one. Repeated rows are judged one by one. Rules with a null host or path, or another
verdict than allow or block, are left out; repeated rules count once. Without rules all URLs get the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, max_labels: int, lengths: list[int]) -> Column:
    """The host suffixes of up to max_labels labels, each with the path's prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, max_labels)))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda x: F.concat(s, F.substring(path, F.lit(1), x)))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')").select("host", "path", "verdict").distinct()
    rules = rules.select(
        F.concat("host", "path").alias("rule"),
        F.struct(F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "allow").alias("allowed"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")).alias("won"),
        F.length("path").alias("path_length"),
        F.size(F.split("host", r"\.")).alias("labels"),
    )
    # both are bounded by the length of a URL, whatever the number of rules
    bounds = rules.agg(F.coalesce(F.max("labels"), F.lit(0)), F.array_sort(F.collect_set("path_length"))).first()
    digest = F.sha2(F.col("rule"), 256)
    rules = rules.select(F.substring(digest, 1, prefix_hex).alias("rule_prefix"), digest.alias("rule_digest"), "won")

    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    asked = urls.withColumn("expression", F.explode_outer(expressions(F.col("host"), F.col("path"), bounds[0], bounds[1] or [0])))
    asked = asked.withColumn("digest", F.sha2(F.col("expression"), 256)).withColumn("prefix", F.substring("digest", 1, prefix_hex)).drop("expression")
    # one row a URL leaves each task: what the prefix brings together is confirmed and the longest rule kept before
    # rows are dealt again
    met = asked.join(rules, F.col("prefix") == F.col("rule_prefix"), "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("won"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(confirmed).alias("won"))
    return best.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
