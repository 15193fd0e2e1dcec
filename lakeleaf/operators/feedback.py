"""Curation events and what they change: canonical and stale documents, wrong and added relationships, merges."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeleaf.functions.ids import stable_id

#: The kinds of events, each with the kind of target that it is for.
KINDS = {"document_canonical": "document", "document_stale": "document", "relationship_wrong": "edge", "relationship_add": "node", "node_merge": "node"}


def targets(feedback: DataFrame, kind: str) -> DataFrame:
    """Distinct ids that events of ``kind`` are about."""
    return feedback.filter((F.col("feedback_kind") == kind) & (F.col("target_kind") == KINDS[kind])).select(F.col("target_id").alias("id")).distinct()


def with_canonical(documents: DataFrame, feedback: DataFrame, key: str = "id") -> DataFrame:
    """Adds canonical: whether some event says so."""
    found = targets(feedback, "document_canonical").select(F.col("id").alias("canonical_id"))
    return documents.join(found, F.col(key) == F.col("canonical_id"), "left").withColumn("canonical", F.col("canonical_id").isNotNull()).drop("canonical_id")


def without_stale(documents: DataFrame, feedback: DataFrame, key: str = "id") -> DataFrame:
    gone = targets(feedback, "document_stale").select(F.col("id").alias("stale_id"))
    return documents.join(gone, F.col(key) == F.col("stale_id"), "left_anti")


def without_wrong(edges: DataFrame, feedback: DataFrame, key: str = "id") -> DataFrame:
    wrong = targets(feedback, "relationship_wrong").select(F.col("id").alias("wrong_id"))
    return edges.join(wrong, F.col(key) == F.col("wrong_id"), "left_anti")


def check_event(event: dict[str, Any]) -> dict[str, Any]:
    """A valid event with defaults filled in; ValueError otherwise."""
    kind, target = event.get("feedback_kind", "").strip(), event.get("target_id", "").strip()
    if kind not in KINDS:
        raise ValueError(f"unsupported feedback kind {kind!r}")
    if event.get("target_kind", KINDS[kind]) != KINDS[kind]:
        raise ValueError(f"{kind} is about a {KINDS[kind]}, not a {event['target_kind']}")
    if not target:
        raise ValueError("target_id is required")
    text = event.get("payload_json") or "{}"
    try:
        payload = json.loads(text)
    except ValueError as e:
        raise ValueError("payload_json is not JSON") from e
    word = lambda name: str(payload.get(name) or "").strip()
    if kind == "relationship_add":
        if not (word("src_id") and word("dst_id") and word("kind")):
            raise ValueError("relationship_add needs src_id, dst_id and kind")
        try:
            json.loads(word("metadata_json") or "{}")
        except ValueError as e:
            raise ValueError("metadata_json is not JSON") from e
    if kind == "node_merge":
        if not word("merged_into"):
            raise ValueError("node_merge needs merged_into")
        if word("merged_into") == target:
            raise ValueError("a node can't be merged into itself")
    return event | {"feedback_kind": kind, "target_kind": KINDS[kind], "target_id": target, "payload_json": text, "actor": event.get("actor", "")}


def manual_edges(feedback: DataFrame) -> DataFrame:
    """The edges that relationship_add and node_merge events stand for, in the columns of ``edges``."""
    shape = "edge_id string, src_id string, dst_id string, merged_into string, kind string, confidence double, evidence_section_id string, source_revision string, metadata_json string"
    p = feedback.filter(F.col("feedback_kind").isin("relationship_add", "node_merge")).withColumn("p", F.from_json("payload_json", shape))
    merge = F.col("feedback_kind") == "node_merge"
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    src = F.when(merge, F.col("target_id")).otherwise(F.trim("p.src_id"))
    dst = F.trim(F.when(merge, F.col("p.merged_into")).otherwise(F.col("p.dst_id")))
    kind = F.when(merge, F.lit("merged_into")).otherwise(F.trim("p.kind"))
    own: Column = stable_id("edge", F.lit("manual"), src, kind, dst)
    given = lambda c, default: F.when(merge, F.lit(default)).otherwise(F.coalesce(c, F.lit(default)))
    return p.select(
        F.when(merge, own).otherwise(F.coalesce(blank(F.col("p.edge_id")), own)).alias("id"), src.alias("src_id"), dst.alias("dst_id"), kind.alias("kind"),
        F.when(~merge & (F.col("p.confidence") > 0), F.col("p.confidence")).otherwise(F.lit(1.0)).alias("confidence"), F.lit("manual").alias("provenance"),
        F.when(~merge, blank(F.col("p.evidence_section_id"))).alias("evidence_section_id"), given(F.col("p.source_revision"), "").alias("source_revision"),
        F.when(merge, F.lit('{"feedback_kind":"node_merge"}')).otherwise(F.coalesce(blank(F.col("p.metadata_json")), F.lit("{}"))).alias("metadata_json"),
    )


def matching(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The rows with the wanted values; an empty value is no filter."""
    for column, value in wanted.items():
        if value.strip():
            rows = rows.filter(F.col(column) == value.strip())
    return rows


def list_events(feedback: DataFrame, target_kind: str = "", target_id: str = "", feedback_kind: str = "", limit: int = 20) -> DataFrame:
    """The newest events first (by seq); an empty filter is none; a limit outside 1 to 100 is 20."""
    return matching(feedback, {"target_kind": target_kind, "target_id": target_id, "feedback_kind": feedback_kind}).orderBy(F.desc("seq")).limit(limit if 0 < limit <= 100 else 20)
