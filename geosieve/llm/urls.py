"""URL filters: host-suffix and path-prefix expressions met by hash prefix, digest and precedence.

Method (native, DataFrame functions only): a rule is the expression host + path. A url is expanded
into one expression for each host suffix and path prefix of a length that some rule has. The two
sides meet in an equi-join on the first four bytes of the SHA-256 digest; the full digest and the
two parts then confirm a match, and the longest matching rule wins (of equally long ones that with
the longer host, then the least text).

Scale: the expressions of a url are bounded by the rule shapes (label counts x path lengths), not
by the length of the url. Rules are broadcast only after counting them; otherwise both sides are
shuffled by hash prefix and adaptive execution splits a hot prefix. The best rule of a url is a
partial aggregate, so a host with a third of all urls is summed up before it is shuffled.

Defined results: a null url, or one without ``://``, has empty host and path; a url that no rule
fits gets the default verdict and a null rule; repeated rows give one row (one per page_id and
url); rules with null or unknown parts are refused; no rules means the default for all. Other
columns of the input are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.llm.tables import BROADCAST_ROWS

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*+)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^([^?#]*+)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_LOWER), empty), F.coalesce(path, empty)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """(id, url, host, path, rule, verdict) per distinct id and url.

    ``rules`` has host, path and verdict ('allow' or 'block').
    """
    rules = rules.select("host", "path", "verdict").distinct()
    bad, count = rules.agg(
        F.count_if(F.col("host").isNull() | F.col("path").isNull()
                   | ~F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False))),
        F.count(F.lit(1))).first()
    if bad:
        raise ValueError(f"{bad} rules lack a host, a path or a known verdict")
    # One row per shape; a shape has at most (labels x path lengths) entries of the rules themselves.
    shapes = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))),
        F.sort_array(F.collect_set(F.length("path")))).first()
    expressions = rules.select(
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("rule_digest"), "verdict",
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"),
    ).withColumn("key", F.substring("rule_digest", 1, 8))
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col), F.col(url_col)).withColumns({"host": host, "path": path})
    labels = F.size(F.split("host", r"\."))
    suffixes = F.filter(F.array(*(F.when(labels >= n, F.substring_index("host", ".", -n)) for n in shapes[0]))
                        if shapes[0] else F.array().cast("array<string>"), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shapes[1]))
                        if shapes[1] else F.array().cast("array<string>"), lambda x: x.isNotNull())
    spread = urls.select(id_col, url_col, "host", "path", F.explode_outer(suffixes).alias("suffix")).select(
        id_col, url_col, "host", "path", "suffix", F.explode_outer(prefixes).alias("prefix"))
    digest = F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)
    spread = spread.select(id_col, url_col, "host", "path", digest.alias("digest"))
    right = F.broadcast(expressions) if count <= BROADCAST_ROWS else expressions
    met = spread.join(right, (F.substring("digest", 1, 8) == F.col("key"))
                      & (F.col("digest") == F.col("rule_digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(
        F.length("rule").alias("n"), "host_length", "rule", "verdict"))).alias("best")
    return met.groupBy(id_col, url_col, "host", "path").agg(best).select(
        id_col, url_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
