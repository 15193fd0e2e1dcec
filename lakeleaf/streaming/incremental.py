"""Incremental indexing as a stream: new files of sections, or of feedback events, join the store batch by batch.

The engine itself works in batches; this is an extension for folders that keep growing. Each micro-batch is one
commit of the store, and a batch that is run again after a failure changes nothing, as rows are replaced by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lakeleaf.operators import feedback as FB
from lakeleaf.operators import graph
from lakeleaf.plans import sync
from lakeleaf.plans.store import SCHEMAS, Seen, Store


def rows_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a table's rows, as they arrive."""
    return spark.readStream.schema(SCHEMAS[table]).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _started(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The source of documents that only the stream has told of.
STREAM = ("stream", "static", "stream")


def follow_sections(store: Store, folder: str, checkpoint: str) -> StreamingQuery:
    """New sections replace the old ones of their documents, whose profiles and graph are made anew, so that they are
    found at once. A document that the store doesn't know gets a row, titled by its first section."""

    def put(batch: DataFrame, _: int) -> None:
        secs = graph.one_per_id(batch, [F.desc("ordinal")]).persist()

        def change(seen: Seen) -> None:
            known = store.table("documents", seen)
            own = secs.groupBy(F.col("document_id").alias("id")).agg(F.min_by("title", "ordinal").alias("first"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("content", 256))), ""), 256).alias("hash"))
            docs = own.join(known, "id", "left").select(
                "id", F.coalesce("source_id", F.lit(STREAM[0])).alias("source_id"), F.coalesce("external_id", "id").alias("external_id"), F.coalesce("title", "first").alias("title"), F.col("hash").alias("content_hash"),
                *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("url", ""), ("version", ""), ("metadata_json", "{}"), ("acl_json", "{}"))], F.coalesce("page_anchors", F.array().cast("array<string>")).alias("page_anchors"), F.current_timestamp().alias("indexed_at"),
            )
            sources = store.table("sources", seen).select("id", "kind", "product_hint", "module_hint").unionByName(store.spark.createDataFrame([(*STREAM[:2], "", "")], "id string, kind string, product_hint string, module_hint string"))
            store.commit(sync.replaced(store, seen, sources, docs.select(*known.columns), secs, docs.limit(0).select(F.col("id").alias("document_id"))), seen, {"sources"})

        store.again(change)
        secs.unpersist()

    return _started(rows_stream(store.spark, folder, "sections"), checkpoint, put)


def follow_feedback(store: Store, folder: str, checkpoint: str) -> StreamingQuery:
    """Events join the log, each id once, and put the edges that they stand for."""

    def put(batch: DataFrame, _: int) -> None:
        batch = graph.one_per_id(batch, [F.desc("seq")]).persist()
        edges = FB.manual_edges(batch).select(*graph.EDGE)
        store.again(lambda seen: store.commit({"feedback": graph.upsert(store.table("feedback", seen), batch), "edges": graph.upsert(store.table("edges", seen), edges)}, seen))
        batch.unpersist()

    return _started(rows_stream(store.spark, folder, "feedback"), checkpoint, put)


def counts_by_kind(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a stream with created_at by window and kind; late ones count up to ``late``."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", every), "feedback_kind").agg(F.count("*").alias("n"))
