"""Operator 7, URL filters, with DataFrame functions only.

Every URL is expanded into host-suffix x path-prefix expressions (a few lengths that the rules use). The expressions
meet the rules by an equi-join on the first four bytes of their SHA-256; a match must then agree in the full digest.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import SALTS

#: Up to so many rules are broadcast (under 20 MB); more are joined by a salted shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to one of ``/?#``, then up to one of ``?#``. Else both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def expressions(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Each (host suffix of so many labels) + (path prefix of so many characters) that the URL has.

    ``labels`` and ``lengths`` are those that occur among the rules, so the count per URL is set by the rules alone.
    """
    parts = F.split(host, r"\.", -1)
    suffixes = F.filter(F.array(*[F.when(F.size(parts) >= n, F.substring_index(host, ".", -n)) for n in labels]), lambda h: h.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def _digest(host: Column, path: Column) -> Column:
    # Length first: a host ending and a path beginning with the same text can't be confused.
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def url_filter(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Judge each row's url: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest rule (host and path
    together) wins; of equally long ones the longer host, then ``block``. Without a rule, rule is null and verdict
    ``default``. A null url, or one without ``://``, has an empty host and path. Repeated rows are repeated in the
    result; rows are otherwise matched by (page_id, url), so nulls are fine. Other columns are ignored, and an empty table
    gives an empty result. A very long url has no more expressions than a short one, as the rules set their number.
    """
    spark = pages.sparkSession
    rules = list(dict.fromkeys(rules))
    labels = sorted({r.host.count(".") + 1 for r in rules}) or [1]
    lengths = sorted({len(r.path) for r in rules}) or [0]
    known = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, rule_verdict string")
    full = _digest(F.col("rule_host"), F.col("rule_path"))
    known = known.select(F.substring(full, 1, 8).alias("prefix"), full.alias("rule_digest"), "rule_host", "rule_path", "rule_verdict")

    # One row per distinct (page_id, url): later grouping by them needs no second shuffle.
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    host, path = url_parts(F.col("url"))
    rows = rows.select("page_id", "url", "copies", host.alias("host"), path.alias("path"))
    asked = rows.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("e"))
    asked = asked.withColumn("asked_digest", _digest(F.col("e.host"), F.col("e.path"))).withColumn("prefix", F.substring("asked_digest", 1, 8)).drop("e")
    if len(rules) <= BROADCAST_RULES:
        met = asked.join(F.broadcast(known), "prefix", "left")
    else:
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(known, ["prefix", "salt"], "left")
    fits = F.col("asked_digest") == F.col("rule_digest")
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("long"), F.length("rule_host").alias("host_long"),
        (F.col("rule_verdict") == "block").alias("block"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
    )
    best = met.groupBy("page_id", "url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("copies").alias("copies"), F.max(F.when(fits, order)).alias("best"))
    out = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "copies")
    return out.select("page_id", "host", "path", "rule", "verdict", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
