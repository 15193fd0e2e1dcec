"""Operator 4, exact top-k search by distributed histogram selection.

Queries are taken in blocks of a fixed size, each of which is broadcast. For a block every candidate is scored; the
scores' global histograms locate the bin with the k-th best score, and that bin is cut into finer ones until it holds
one value. Then the candidates at or above that value are filtered, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeleaf.llm.common import materialise

#: Queries in a block (at most 4096 x 64 x 8 bytes to broadcast, for 64 components), and bins of a histogram.
QUERY_BLOCK, BINS = 4096, 512
#: Rows scored at a time in a task, and the largest score.
ROWS, LONGEST = 256, (1 << 63) - 1


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as double; null if the vector or a component is null or not finite."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda v: F.floor(x(v) * 256).cast("long")))


def _matrix(column: pd.Series, width: int, kind: type) -> np.ndarray:
    return np.stack(column.to_list()).astype(kind) if len(column) else np.zeros((0, width), kind)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's k candidates with the highest integer inner products: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the input's columns. Candidates are all rows with another id than the query's;
    ties go to the smaller id; with fewer candidates all are given. A score beyond the range of a long is given, and
    compared, as the nearest long (+-(2^63 - 1)). Vectors that are null or hold a null or
    non-finite component, and rows with a null id, take no part. Vectors of unlike lengths score 0 in the missing
    places. Rows that repeat an id are candidates each; queries that repeat one are asked once, by the row with the
    smallest vector. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding)).alias("v"), is_query.alias("asked")).filter("vec_id is not null and v is not null")
    # Integer vectors as they are sent on; the exact bounds decide the arithmetic.
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = good.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("norm"), F.count(F.when(F.col("asked"), 1)).alias("asked")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["asked"]:
        return spark.createDataFrame([], schema)
    width, bound = int(facts["width"]), min(int(facts["norm"]) + 1, LONGEST)  # |score| <= bound, by Cauchy and Schwarz
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
    pad = lambda c: F.concat(c, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(c)))
    good = good.withColumn("v", pad(F.col("v")))
    queries = materialise(good.filter("asked").groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries").orderBy("vec_id")

    results, block = [], []
    for row in queries.toLocalIterator():
        block.append((row["vec_id"], row["v"]))
        if len(block) == QUERY_BLOCK:
            results.append(_block(good, block, k, bound, width, kind))
            block = []
    if block:
        results.append(_block(good, block, k, bound, width, kind))
    return reduce(DataFrame.unionByName, results)


def _scored(batches: Iterator[pd.DataFrame], queries: np.ndarray, width: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of some rows, and scores (queries x rows)."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.iloc[at : at + ROWS]
            scores = queries @ _matrix(part["v"], width, kind).T
            yield part["vec_id"].to_numpy(), np.clip(scores, -LONGEST, LONGEST) if kind is object else scores.astype(np.int64)


def _block(good: DataFrame, block: list[tuple[int, list[int]]], k: int, bound: int, width: int, kind: type) -> DataFrame:
    spark = good.sparkSession
    ids = np.array([i for i, _ in block])
    sent = spark.sparkContext.broadcast((ids, np.array([v for _, v in block]).astype(kind)))
    rows = good.select("vec_id", "v")
    # Of each query: the interval low <= score < low + span in which its k-th best score lies, cut into bins of step,
    # and how many of the k best are still to be found in it (those above the interval are counted off).
    # Integers beyond 2**53 are Python's own throughout, so that no sum overflows.
    low = np.full(len(ids), -bound, dtype=object if kind is object else np.int64)
    need = np.full(len(ids), k, dtype=np.int64)
    span = 2 * bound + 1
    step = -(-span // BINS)
    while True:
        state = spark.sparkContext.broadcast((low, step, span))

        def histogram(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            (own, queries), (lows, width_of, whole) = sent.value, state.value
            counts = np.zeros((len(own), BINS), dtype=np.int64)
            base = np.arange(len(own))[:, None] * BINS
            for found, scores in _scored(batches, queries, width, kind):
                place = scores - lows[:, None]
                inside = ((place >= 0) & (place < whole)).astype(bool) & (found[None, :] != own[:, None])
                counts += np.bincount((base + place // width_of)[inside].astype(np.int64), minlength=counts.size).reshape(counts.shape)
            # A bin under this task's own k best can't hold the k-th best of all.
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < k))
            yield pd.DataFrame({"query": q.astype("int32"), "bin": b.astype("int32"), "n": counts[q, b]})

        found = rows.mapInPandas(histogram, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        # At most k bins of a query matter; the rest is counted off here, in Spark.
        above = F.coalesce(F.sum("n").over(W.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        kept = found.withColumn("above", above).filter(F.col("above") < k).toPandas().sort_values(["query", "bin"], ascending=[True, False])
        total = kept.groupby("query")["n"].sum().reindex(range(len(ids)), fill_value=0).to_numpy()
        wanted = need[kept["query"].to_numpy()]
        hit = kept[(kept["above"].to_numpy() < wanted) & (kept["above"].to_numpy() + kept["n"].to_numpy() >= wanted)]
        q, b, over = hit["query"].to_numpy(), hit["bin"].to_numpy().astype(np.int64), hit["above"].to_numpy()
        low[q] += b * step
        need[q] -= over
        few = np.flatnonzero(total < need)  # fewer candidates than k: all are taken
        low[few], need[few] = -bound - 1, 0
        if step == 1:
            break
        span, step = step, -(-step // BINS)
    kth = spark.sparkContext.broadcast((low, need))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (own, queries), (values, ties) = sent.value, kth.value
        tied: dict[int, list[int]] = {}
        for found, scores in _scored(batches, queries, width, kind):
            other = found[None, :] != own[:, None]
            q, c = np.nonzero((scores > values[:, None]).astype(bool) & other)
            yield pd.DataFrame({"query_id": own[q], "vec_id": found[c], "score": scores[q, c].astype(np.int64)})
            q, c = np.nonzero((scores == values[:, None]).astype(bool) & other)
            for i, j in zip(q.tolist(), c.tolist()):
                tied.setdefault(i, []).append(int(found[j]))
            for i in set(q.tolist()):  # only so many of the tied ones can be wanted
                tied[i] = sorted(tied[i])[: int(ties[i])]
        yield pd.DataFrame([(own[i], j, values[i]) for i, js in tied.items() for j in js], columns=["query_id", "vec_id", "score"]).astype("int64")

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.mapInPandas(best, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
