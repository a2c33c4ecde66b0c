"""URL filters: host-suffix and path-prefix rules, by an equi-join on short hash prefixes.

A URL is expanded into the (host suffix, path prefix) expressions that some rule could
equal: a suffix for each label count and a prefix for each path length that occurs among
the rules, so a URL of any length gives at most as many expressions as the rules have
shapes. Expressions meet rules on the first 8 hex digits of their SHA-256; the full digest
then confirms, and of the rules that fit the longest wins.

Cases: a null URL, or one without ``://``, has empty host and path and gets the default
verdict. Host and path are empty strings when the URL has none. Of two rules of one length the
one with the longer host wins, of one expression stated twice ``block`` wins over ``allow``.
Repeated URLs are judged once and each row keeps its verdict; null ids and any further
columns pass through, except those named like an output column. No pages or no rules: no rows,
or the default verdict for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, with_columns

PREFIX_HEX = 8  # 32 bits of the digest


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host + path of the rule that won, else null) and verdict.

    ``rules`` has the string columns host, path and verdict (``allow`` or ``block``).
    """
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), F.col("path"), "verdict").dropna().distinct()
    shapes = rules.select(_labels(F.col("host")).alias("n"), F.length("path").alias("p")).distinct()
    # one row per shape (label count, path length): bounded by the lengths a URL can have, not by the rules
    shapes = sorted((r.n, r.p) for r in shapes.collect())
    urls = (pages.select(F.col(f"`{url}`").alias("__url")).where(F.col("__url").contains("://")).distinct()
            .withColumn("__h", host_of(F.col("__url"))).withColumn("__p", path_of(F.col("__url"))))
    fits = [F.when((_labels(F.col("__h")) >= n) & (F.length("__p") >= p),
                   F.struct(F.substring_index("__h", ".", -n).alias("h"), F.substring("__p", 1, p).alias("p")))
            for n, p in shapes]
    found = (urls.withColumn("__e", F.explode(F.array_compact(F.array(*fits)) if fits else F.expr(
                "cast(array() as array<struct<h:string,p:string>>)")))
             .select("__url", _digest(F.col("__e.h"), F.col("__e.p")).alias("__d")))
    found = found.withColumn("__short", F.substring("__d", 1, PREFIX_HEX))
    known = rules.withColumn("__rd", _digest(F.col("host"), F.col("path"))).withColumn(
        "__rshort", F.substring("__rd", 1, PREFIX_HEX))
    best = (found.join(known, F.col("__short") == F.col("__rshort")).where("__d = __rd")
            .groupBy("__url")
            .agg(F.max(F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"),
                                "verdict", F.concat("host", "path").alias("rule"))).alias("__best")))
    out = pages.join(best, F.col(f"`{url}`") == F.col("__url"), "left")
    out = with_columns(out, {
        "host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`")),
        "rule": F.col("__best.rule"), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default))})
    return out.drop("__url", "__best")
