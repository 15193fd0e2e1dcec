"""Context packs: the sections for a task, cut to a budget of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeleaf.functions import text as X

LEAST = 200


@dataclass(frozen=True)
class Request:
    task: str = ""
    query: str = ""
    max_sections: int = 8
    max_chars: int = 12000

    def clamped(self) -> Request:
        query, task = self.query.strip(), self.task.strip()
        if not query and not task:
            raise ValueError("task or query is required")
        return Request(task, query or task, self.max_sections if 0 < self.max_sections <= 20 else 8, self.max_chars if 0 < self.max_chars <= 20000 else 12000)


def budgets(hits: DataFrame, total: int, key: str = "place") -> DataFrame:
    """Adds budget. Shares go by max(rank, 0.1), so the sign of the rank decides: matches have negative ranks and weigh
    0.1, substring hits weigh 1000 and more. Each share is at least LEAST bytes; what is then too much is taken back
    from the last hit upwards, never below LEAST.
    """
    all_ = W.partitionBy(F.lit(0))
    rows = hits.withColumn("weight", F.greatest("rank", F.lit(0.1)))
    share = F.floor(F.lit(float(total)) * F.col("weight") / F.sum("weight").over(all_)).cast("long")
    rows = rows.withColumn("share", F.greatest(share, F.lit(LEAST)))
    excess = F.greatest(F.sum("share").over(all_) - total, F.lit(0))
    after = F.coalesce(F.sum(F.col("share") - LEAST).over(all_.orderBy(F.desc(key)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    back = F.least(F.greatest(excess - after, F.lit(0)), F.col("share") - LEAST)
    return rows.withColumn("budget", F.col("share") - back).drop("weight", "share")


def evidence(title: Column, path: Column, url: Column) -> Column:
    return F.array_join(F.filter(F.array(title, path, url), lambda v: v.isNotNull() & (X.trim_space(v) != "")), " | ")


def pack(hits: DataFrame, request: Request) -> DataFrame:
    """hits: of a search (place, rank, content, ...), at most max_sections. In their order each takes up to its budget
    of what is left of the whole, cut at paragraphs; hits after the budget is used up are left out."""
    r = request.clamped()
    rows = budgets(hits.filter(F.col("place") <= r.max_sections), r.max_chars)
    rows = rows.withColumn("evidence", evidence(F.col("title"), F.col("heading_path"), F.col("document_url")))
    rows = rows.select("place", "section_id", "document_id", "document_title", "document_url", "desc", "title", "heading_path", "content", "budget", "evidence").coalesce(1).sortWithinPartitions("place")

    def consume(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = r.max_chars
        for batch in batches:  # at most 20 rows in all
            kept = []
            for i, (content, budget) in enumerate(zip(batch["content"], batch["budget"])):
                if left <= 0:
                    break
                text = X.truncate_paragraphs(content.strip(), min(int(budget), left))
                left -= len(text.encode())
                kept.append((i, text))
            out = batch.iloc[[i for i, _ in kept]].copy()
            out["content"] = [t for _, t in kept]
            yield out

    return rows.mapInPandas(consume, rows.schema)
