"""Connected components of a table of links, by least labels with pointer jumping; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). node, label (the smallest node of its component) for every node that has a link.

    A round takes the least label among a node's neighbours and then that label's own label, so the longest path
    is about halved; rounds end when no label changes. No node's links meet in one task beyond the shuffle by node,
    which the callers keep small by pairing through sub-leaders.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-links")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "components-labels")
    while True:
        near = both.hint("merge").join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("label").alias("near")).withColumnRenamed("b", "node")
        least = labels.hint("merge").join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # Every label is a node with a label of its own.
        jumped = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        salted = least.hint("merge").join(jumped, "label").select("node", "old", F.least("label", "next").alias("label"))
        after = materialise(salted, "components-labels")
        if after.filter("old <> label").isEmpty():
            return labels
        labels = after.select("node", "label")
