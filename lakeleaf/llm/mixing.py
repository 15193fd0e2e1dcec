"""Operator 6, mixing sources to target weights by hierarchical budgeting.

A token budget runs down a domain - language - source tree. At each node it is dealt to the children by weight; a
child that holds less than its share is filled, and the shortage goes to its siblings. Only when all of a node's
leaves are full does the rest reach the node's own siblings. Each leaf then takes whole epochs of its documents and
a prefix, by tokens, of one more epoch, in an order seeded by (seed, epoch, doc_id).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeleaf.llm.common import materialise

#: Leaves up to which their table is broadcast (under 20 MB); more are joined by a salted shuffle.
BROADCAST_LEAVES = 100_000
#: Buckets of an epoch's order, by the first three hexadecimal digits of the hash.
DIGITS = 3
LEVELS = ("domain", "language", "source")


@dataclass(frozen=True)
class Mixture:
    """weights: for each level the whole-number weight of each child name; others weigh ``other``. budget: tokens, or
    a share of all tokens as (numerator, denominator). epochs: how often a document is taken at most. crossing: a leaf's
    prefix includes the document that crosses its budget, so that no leaf gives less than its budget."""

    budget: int | tuple[int, int]
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    other: int = 1
    epochs: int = 1
    seed: int = 0
    crossing: bool = False


def word_count(text: Column) -> Column:
    """Runs of signs other than white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def keys(docs: DataFrame, domain: Column, tokens: Column, doc_id: str = "doc_id", language: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, domain, language, source, n_tokens of each row; nulls in the three names are the empty name."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), name(domain).alias("domain"), name(F.col(language)).alias("language"), name(F.col(source)).alias("source"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("n_tokens"))


def weight_of(mixture: Mixture, level: str) -> Column:
    known = mixture.weights.get(level, {})
    out = F.lit(mixture.other)
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def dealt(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent columns, name, weight, cap and budget (the parent's). Adds share: what the child gets.

    In the order of cap / weight the children that fill up come first; child i does iff cap_i x (weights from i on)
    <= (budget - caps before i) x weight_i. The others divide what is left by weight, rounded down.
    """
    nodes = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0)).cast("long"))
    # A parent without columns of its own is the root, whose children are few.
    whole = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = whole.orderBy((F.col("cap") / F.greatest("weight", F.lit(1))).asc(), F.col(name).asc())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    nodes = nodes.withColumn("total", F.least("budget", F.sum("cap").over(whole)))
    nodes = nodes.withColumn("full", F.col("cap") * after <= (F.col("total") - before) * F.col("weight"))
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(whole)
    left = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(whole)
    nodes = nodes.withColumn("taken", taken).withColumn("left", left)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("((total - taken) * weight) div greatest(left, 1)"))
    return nodes.withColumn("share", share).drop("total", "full", "taken", "left")


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """leaves: domain, language, source, tokens. Adds budget: the tokens that each leaf is to give."""
    caps = leaves.withColumn("cap", F.col("tokens") * mixture.epochs)
    if isinstance(mixture.budget, tuple):
        up, down = mixture.budget
        whole = leaves.agg(F.expr(f"(coalesce(sum(tokens), 0) * {int(up)}) div {int(down)}").alias("budget"))
    else:
        whole = leaves.sparkSession.createDataFrame([(mixture.budget,)], "budget long")
    above, parent = whole, []
    for level in LEVELS:
        path = [*parent, level]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(mixture, level))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # one row
        above = dealt(nodes, parent, level).select(*path, F.col("share").alias("budget"))
        parent = path
    return leaves.join(above, list(LEVELS))


def place(epoch: Column, seed: int, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _at_leaf(docs: DataFrame, leaves: DataFrame, few: bool) -> DataFrame:
    if few:
        return docs.join(F.broadcast(leaves), list(LEVELS))
    spread = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(256)).cast("int")).join(spread, [*LEVELS, "salt"]).drop("salt")


def plan(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """rows: of ``keys``. One row per leaf: budget, whole (epochs), and where the prefix of the next epoch ends: it takes
    the buckets before ``upto``, and of that bucket the documents up to ``last`` (place and id; null: none).

    The prefix is found in two steps, so that a leaf with a third of all documents is never sorted by one task: running
    totals over the 16**DIGITS buckets of the order give the one bucket in which the budget ends, and only that
    bucket's documents, about one in 16**DIGITS, are shuffled and sorted.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = budgets(leaves, mixture).withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int"))
    leaves = materialise(leaves.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mixing-leaves")
    few = leaves.count() <= BROADCAST_LEAVES

    def placed(with_: DataFrame) -> DataFrame:
        met = _at_leaf(rows, with_, few).withColumn("place", place(F.col("whole") + 1, mixture.seed, F.col("doc_id")))
        return met.withColumn("bucket", F.substring("place", 1, DIGITS))

    asked = leaves.filter("rest > 0").select(*LEVELS, "whole", "rest")
    sums = placed(asked).groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("rest"))
    by_leaf = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.withColumn("after", F.sum("in_bucket").over(by_leaf)).filter("after >= rest" if mixture.crossing else "after > rest")
    ends = sums.groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("after") - F.col("in_bucket")).alias("before")), "bucket").alias("end"))
    ends = materialise(asked.join(ends, list(LEVELS)).select(*LEVELS, "whole", "rest", F.col("end.bucket").alias("upto"), F.col("end.before").alias("before")), "mixing-ends")
    near = placed(ends).filter("bucket = upto").select(*LEVELS, "place", "doc_id", "n_tokens", "rest", "before")
    inside = W.partitionBy(*LEVELS).orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    prefix = near.withColumn("total", F.col("before") + F.sum("n_tokens").over(inside)).filter("total - n_tokens < rest" if mixture.crossing else "total <= rest")
    last = prefix.groupBy(*LEVELS).agg(F.max(F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("last"))
    found = leaves.join(ends.select(*LEVELS, "upto"), list(LEVELS), "left").join(last, list(LEVELS), "left")
    # Buckets are hexadecimal digits: all are after "" and before "g".
    upto = F.when(F.col("rest") <= 0, "").otherwise(F.coalesce("upto", F.lit("g")))
    return materialise(found.select(*LEVELS, "tokens", "docs", "budget", "whole", upto.alias("upto"), "last"), "mixing-plan")


def copies(rows: DataFrame, leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``rows`` with copies: how often each row is taken. Rows that repeat (leaf, doc_id) go in or stay out together
    with the last of them."""
    few = leaves.count() <= BROADCAST_LEAVES
    met = _at_leaf(rows, leaves.select(*LEVELS, "budget", "whole", "upto", "last"), few)
    met = met.withColumn("place", place(F.col("whole") + 1, mixture.seed, F.col("doc_id")))
    bucket, mine = F.substring("place", 1, DIGITS), F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    extra = (bucket < F.col("upto")) | ((bucket == F.col("upto")) & F.col("last").isNotNull() & (mine <= F.col("last")))
    return met.withColumn("copies", F.col("whole") + F.when(extra, F.lit(1)).otherwise(F.lit(0)))


def mix(docs: DataFrame, mixture: Mixture, domain: Column, tokens: Column, doc_id: str = "doc_id", language: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, domain, language, source, n_tokens, copies; one row per input row.

    copies is how often the mixture takes the document (0: not). A leaf's prefix ends before the document that would
    exceed its budget, or with ``crossing`` after it. Documents without tokens cost nothing: they are taken if their place is within the prefix.
    Null names are the empty name, a null text has no tokens, a null doc_id counts as the empty text in the order.
    Rows that repeat are documents each, taken or left together. Very long texts are counted whole. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = materialise(keys(docs, domain, tokens, doc_id, language, source), "mixing-keys")
    out = copies(rows, plan(rows, mixture), mixture)
    return out.select("doc_id", "domain", "language", "source", "n_tokens", "copies")


def take(docs: DataFrame, mixture: Mixture, domain: Column, tokens: Column, doc_id: str = "doc_id", language: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, with all their columns. Texts are not shuffled."""
    rows = materialise(keys(docs, domain, tokens, doc_id, language, source), "mixing-keys")
    leaves = plan(rows, mixture)
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), name(domain).alias("domain"), name(F.col(language)).alias("language"), name(F.col(source)).alias("source"))
    out = copies(wide, leaves, mixture).filter("copies > 0")
    if mixture.epochs > 1:
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("row.*")
