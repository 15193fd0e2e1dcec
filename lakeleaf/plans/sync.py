"""Bringing a source's documents into the store: parse, replace, drop what is gone, profiles, graph, links."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeleaf.functions.ids import stable_id
from lakeleaf.operators import graph, profiles
from lakeleaf.plans.session import visible, written
from lakeleaf.plans.store import LINKED_KINDS, Seen, Store, attached
from lakeleaf.sources import folders, paths, web


#: Broken links in a job's payload; all are in the store's table ``broken_links``.
LINKS_PAGE = 1000


def load(store: Store, source: dict[str, Any], transport: web.Transport = web.http_get, connect: Callable = folders.connect_sftp) -> tuple[DataFrame, str]:
    """The source's parsed documents, and the prefix of their addresses."""
    spark, kind, dsn, config = store.spark, source["kind"], source["dsn"], source["config_json"]
    if kind in ("local", "html", "static"):
        root = paths.local_path(dsn)
        rows = {"local": folders.scan_markdown, "html": folders.scan_html}.get(kind, lambda s, r: folders.scan_static(s, r, config))(spark, root)
        return rows, paths.url_prefix(config, root)
    if kind == "git":
        found = folders.checkout(dsn, config)
        return folders.scan_markdown(spark, visible(spark, found.root)), paths.url_prefix(config, found.url)
    if kind == "sftp":
        found = folders.Mirror(dsn, source["id"], config, connect).sync()
        return folders.scan_static(spark, visible(spark, found.root), config, mirrored=True), found.url
    if kind == "openapi":
        root = paths.local_path(dsn)
        return folders.scan_openapi(spark, root), paths.url_prefix(config, root.rsplit("/", 1)[0])
    if kind == "confluence":
        return web.Wiki(dsn, config, transport).load(spark), ""
    if kind == "webdocs":
        return web.Site(dsn, config, transport).load(spark), ""
    raise ValueError(f"unsupported source kind {kind!r}")


def engine_rows(parsed: DataFrame, source_id: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Rows of documents and of sections."""
    rows = parsed.withColumn("id", stable_id("doc", F.lit(source_id), F.col("path")))
    joined = F.col("path") if not prefix else F.concat(F.lit(prefix.rstrip("/") + "/"), F.col("path"))
    docs = rows.select(
        "id", F.lit(source_id).alias("source_id"), F.col("path").alias("external_id"), "title", F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(joined).alias("url"), F.coalesce("version", F.lit("")).alias("version"),
        F.col("hash").alias("content_hash"), F.col("anchors").alias("page_anchors"), F.lit("{}").alias("metadata_json"), F.lit("{}").alias("acl_json"), F.current_timestamp().alias("indexed_at"),
    )
    s = rows.select(F.col("id").alias("document_id"), F.explode("sections").alias("s")).select("document_id", "s.*")
    secs = s.select(
        stable_id("sec", F.col("document_id"), F.col("ordinal"), F.col("hash")).alias("id"), "document_id", "ordinal", "title", F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ").alias("heading_path"), "content",
        F.col("hash").alias("content_hash"), F.when(F.coalesce("anchor", F.lit("")) != "", F.array("anchor")).otherwise(F.array().cast("array<string>")).alias("anchors"), "links",
    )
    return docs, secs


@F.pandas_udf(T.ArrayType(T.StringType()))
def _candidates(path: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([paths.href_candidates(p, h) for p, h in zip(path, href)])


def page_links(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """document_id, section_id, href, text, candidates."""
    rows = sections.select("document_id", F.col("id").alias("section_id"), F.explode("links").alias("l"))
    rows = rows.join(documents.select(F.col("id").alias("document_id"), F.col("external_id").alias("path")), "document_id")
    return rows.select("document_id", "section_id", F.col("l.href").alias("href"), F.col("l.text").alias("text"), _candidates("path", F.col("l.href")).alias("candidates"))


def vanished(old: DataFrame, listed: DataFrame) -> DataFrame:
    """The ids of ``old`` that a new listing (ids too) lacks."""
    return old.select("id").join(listed.select("id"), "id", "left_anti")


def sync_source(store: Store, source_id: str, transport: web.Transport = web.http_get, connect: Callable = folders.connect_sftp) -> dict[str, Any]:
    """Sync one source as a job; returns the ended job. A failure leaves the tables as they were."""
    source = store.source(source_id)
    job = store.start_job(source_id)
    try:
        return store.end_job(job["id"], _sync(store, source, transport, connect))
    except Exception as e:
        return store.end_job(job["id"], error=str(e) or type(e).__name__)


def replaced(store: Store, seen: Seen, sources: DataFrame, docs: DataFrame, secs: DataFrame, gone: DataFrame, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables with ``docs`` and their sections in place of what they had of these, and without the documents ``gone``
    (document_id). seen: the snapshot that is read; sources: of the documents; links: further edges."""
    left = store.without_documents(gone, seen)
    mine = docs.select(F.col("id").alias("document_id"))
    all_docs = graph.upsert(left["documents"], docs)
    all_secs = left["sections"].join(mine, "document_id", "left_anti").select(*secs.columns).unionByName(secs)
    nodes, edges = graph.build_graph(sources, docs, secs)
    if links is not None:
        edges = graph.one_per_id(edges.unionByName(links.select(*edges.columns)))
    all_nodes = graph.upsert(left["nodes"], nodes.select(*graph.NODE))
    all_edges = attached(graph.upsert(left["edges"], edges.select(*graph.EDGE)), all_nodes, all_secs)
    others = left["profiles"].join(mine, "document_id", "left_anti")
    fresh = profiles.refresh_profiles(left["profiles"].join(mine, "document_id", "left_semi"), docs, secs)
    return {"documents": all_docs, "sections": all_secs, "nodes": all_nodes, "edges": all_edges, "profiles": others.unionByName(fresh.select(*others.columns))}


def _sync(store: Store, source: dict[str, Any], transport: web.Transport, connect: Callable) -> dict[str, Any]:
    parsed, prefix = load(store, source, transport, connect)
    docs, secs = engine_rows(parsed, source["id"], prefix)
    # Written once: the folder that they come from may change while the tables are made.
    docs, secs = written(docs, "sync-documents"), written(secs, "sync-sections")
    found = missing = None
    if source["kind"] in LINKED_KINDS:
        found, missing = graph.resolve_links(page_links(docs, secs), graph.link_targets(docs, secs))

    def put(seen: Seen) -> None:
        old = store.table("documents", seen).filter(F.col("source_id") == source["id"])
        gone = vanished(old, docs).withColumnRenamed("id", "document_id")
        broken = store.table("broken_links", seen).filter(F.col("source_id") != source["id"])
        if missing is not None:
            broken = broken.unionByName(missing.select(F.lit(source["id"]).alias("source_id"), "*"))
        tables = replaced(store, seen, store.table("sources", seen).filter(F.col("id") == source["id"]), docs, secs, gone, found)
        store.commit(tables | {"broken_links": broken}, seen, {"sources"})

    store.again(put)
    links = store.broken_links(source["id"])
    return {"documents": docs.count(), "broken_link_count": links.count(), "broken_links": [r.asDict() for r in links.limit(LINKS_PAGE).collect()]}


def payload(job: dict[str, Any]) -> dict[str, Any]:
    return json.loads(job["payload_json"])
