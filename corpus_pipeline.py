"""A training-corpus pipeline over ``documents``: each stage is an operator of ``lakeleaf.llm``.

Stages are functions (spark, docs, sf_dir) -> DataFrame. Each result is written as Parquet and reread for the next.
All but the last return the columns of ``documents``.

Columns of any name and type beyond those of ``documents`` are kept as they are, except by the last stage. An empty
table gives an empty result in every stage, and texts of any length are worked on whole.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeleaf.llm.bpe import bpe_digests
from lakeleaf.llm.common import id_fold, materialise, table
from lakeleaf.llm.exact_dedup import drop_exact_copies
from lakeleaf.llm.minhash import drop_near_copies
from lakeleaf.llm.mixing import take, word_count
from lakeleaf.llm.queries import MIXTURE, domain_of, vocabulary
from lakeleaf.llm.toxicity import drop_toxic, train

#: After deduplication no document is to be repeated: thin leaves give all they have, and siblings make up for it.
#: A leaf's last document may cross its budget, as otherwise one long document early in the order empties the leaf.
MIX_ONCE = replace(MIXTURE, epochs=1, crossing=True)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose predicted label is toxic. Learns from the labelled rows outside the held-out fold.

    Null and empty texts are scored as empty ones, repeated rows alike; without labels of both classes all get one score.
    """
    model = train(docs, table(spark, sf_dir, "labels"), id_fold("doc_id", 5) != 0)
    return drop_toxic(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; null, empty and blank texts are equal, of repeated rows one stays."""
    return drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; texts without words and rows with a null id all stay."""
    return drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights and the budget take. Null names are the empty name; texts without words cost
    nothing; repeated rows go in or stay out together."""
    return take(docs, MIX_ONCE, domain_of(), word_count(F.col("text")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, a row for each row; a null text is empty."""
    return bpe_digests(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The trained classifier, the near-duplicate classes and the encoder can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
