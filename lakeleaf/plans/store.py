"""The engine's state: one Parquet table for each kind of row, and numbered version files that name their folders.

A table is a folder of rows and up to DELTAS small folders of changed rows, of which the last for each id counts: a job
or an event is one row written, whatever the table holds. A change ends with a version file of the next number, which
only one writer can make, so readers see all of a change or nothing and no change is lost: a writer who comes second
starts from the new version, or is told of the conflict where both changed the same table. Files are reached through
Hadoop's file systems: the root may be in any store that Spark writes and that renames atomically.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any, TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeleaf.functions.ids import random_id
from lakeleaf.operators import feedback as FB
from lakeleaf.operators import graph, search
from lakeleaf.operators.adjacency import Adjacency
from lakeleaf.operators.context import Request, pack
from lakeleaf.operators.segments import Segments

KINDS = ("local", "git", "html", "static", "sftp", "confluence", "openapi", "webdocs")
LINKED_KINDS = ("html", "static", "sftp", "webdocs")
_LINKS = "array<struct<href:string,text:string>>"
SCHEMAS = {
    "sources": "id string, kind string, name string, dsn string, config_json string, product_hint string, module_hint string, sync_schedule string, created_at timestamp, updated_at timestamp",
    "documents": "id string, source_id string, external_id string, title string, url string, version string, content_hash string, page_anchors array<string>, metadata_json string, acl_json string, indexed_at timestamp",
    "sections": f"id string, document_id string, ordinal int, title string, heading_path string, content string, content_hash string, anchors array<string>, links {_LINKS}",
    "profiles": "document_id string, desc string, retrieval_profile_json string, generated_from_hash string",
    "nodes": "id string, kind string, name string, canonical_name string, metadata map<string,string>, confidence double",
    "edges": "id string, src_id string, dst_id string, kind string, confidence double, provenance string, evidence_section_id string, metadata_json string",
    "broken_links": "source_id string, document_id string, section_id string, href string, target string",
    "jobs": "id string, seq long, kind string, status string, source_id string, payload_json string, attempts int, last_error string, created_at timestamp, updated_at timestamp",
    "feedback": "id string, seq long, target_kind string, target_id string, feedback_kind string, payload_json string, actor string, created_at timestamp",
}
#: Tables whose rows have another key than id.
KEYS = {"profiles": "document_id"}
#: The order within each file of a table, by which look-ups and pages skip what they don't need.
ORDERS = {"documents": ("source_id", "title", "id"), "sections": ("id",), "nodes": ("id",), "edges": ("id",), "profiles": ("document_id",)}
#: Folders of changed rows after which a table's rows are written anew.
DELTAS = 32
#: Entries of a version beside the tables: the index's segments (folder:sections), and what they were made from.
INDEX, STAMP = "index", "index_stamp"
#: The same of the adjacency; its stamp has the folders of nodes and edges.
ADJACENCY, ADJACENCY_STAMP = "adjacency", "adjacency_stamp"
#: Times that a change is tried again after another writer's.
RETRIES = 5
INTERRUPTED = "the process ended while this job was running"


class NotFound(ValueError):
    """No such row."""


class Conflict(RuntimeError):
    """Another writer changed the same table meanwhile."""


class SyncInProgress(ValueError):
    """A source has a running job already."""


def now() -> datetime:
    return datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)


Seen = tuple[int, dict[str, list[str]]]
T_ = TypeVar("T_")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Versions ---------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder, fs = self._fs(f"{self.root}/_versions")
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def _version(self, number: int) -> dict[str, list[str]]:
        path, fs = self._fs(f"{self.root}/_versions/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def snapshot(self) -> Seen:
        """The last version's number, and the folders of each table: the rows, then the changes."""
        numbers = self._numbers()
        return (numbers[-1], self._version(numbers[-1])) if numbers else (0, {})

    def current(self) -> dict[str, list[str]]:
        return self.snapshot()[1]

    def _publish(self, number: int, tables: dict[str, list[str]]) -> bool:
        """Make the version file of that number; False if another writer has made it."""
        temp, fs = self._fs(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # fails if the file is there
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(self._fs(f"{self.root}/_versions/{number:012d}.json")[0]), options)
            return True
        except Py4JJavaError as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def _commit(self, seen: Seen, new: dict[str, list[str]], read: set[str]) -> None:
        """Publish new folders of some tables, made from the version ``seen`` by reading the tables ``read``."""
        number, base = seen
        while not self._publish(number + 1, base | new):
            number, now_ = self.snapshot()
            changed = {t for t in read | set(new) if now_.get(t) != seen[1].get(t)}
            if changed:
                raise Conflict(f"changed by another writer: {', '.join(sorted(changed))}")
            base = now_

    def _write(self, name: str, rows: DataFrame, schema: str) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        wanted = T.StructType.fromDDL(schema)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
        (rows.sortWithinPartitions(*ORDERS[name]) if name in ORDERS else rows).write.parquet(f"{self.root}/{path}")
        return path

    def commit(self, tables: dict[str, DataFrame], seen: Seen, read: set[str] = frozenset()) -> None:
        """New rows of some tables, all at once. ``seen``: the snapshot that they were made from, taken before anything was
        read; read: further tables that they depend on."""
        self._commit(seen, {name: [self._write(name, rows, SCHEMAS[name])] for name, rows in tables.items()}, set(tables) | read)

    def again(self, change: Callable[[Seen], T_]) -> T_:
        """Run a change from a snapshot; where another writer was first, once more from the new one."""
        for left in reversed(range(RETRIES)):
            try:
                return change(self.snapshot())
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def change(self, changes: dict[str, list[dict[str, Any]]], gone: bool = False, seen: Seen | None = None, read: set[str] = frozenset()) -> None:
        """Put (or with ``gone`` delete) single rows of some tables. A table's rows are written anew after DELTAS changes."""
        seen, new = seen or self.snapshot(), {}
        for name, rows in changes.items():
            own = seen[1].get(name) or [self._write(name, self._frame(name, []), SCHEMAS[name])]
            if len(own) > DELTAS:
                own = [self._write(name, self._read(name, own), SCHEMAS[name])]
            frame = self._frame(name, rows).coalesce(1).withColumns({"change_no": F.lit(len(own)), "change_gone": F.lit(gone)})
            new[name] = [*own, self._write(name, frame, f"{SCHEMAS[name]}, change_no int, change_gone boolean")]
        self._commit(seen, new, set(read))

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{folders[0]}")
        if len(folders) == 1:
            return rows
        key = KEYS.get(name, "id")
        changed = self.spark.read.schema(f"{SCHEMAS[name]}, change_no int, change_gone boolean").parquet(*[f"{self.root}/{f}" for f in folders[1:]])
        last = changed.groupBy(key).agg(F.max_by(F.struct(*changed.columns), "change_no").alias("last")).select("last.*")
        # A few rows of each of at most DELTAS changes.
        return rows.join(F.broadcast(last.select(key)), key, "left_anti").select(*rows.columns).unionByName(last.filter("not change_gone").select(*rows.columns))

    def table(self, name: str, seen: Seen | None = None) -> DataFrame:
        folders = (seen[1] if seen else self.current()).get(name)
        return self._read(name, folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def vacuum(self, keep: int = 10) -> int:
        """Delete all but the last ``keep`` versions and the folders that only they name; returns how many folders. Not
        to be run beside a writer, whose folders no version names yet."""
        numbers = self._numbers()
        kept = {f.rsplit(":", 1)[0] for n in numbers[-keep:] for folders in self._version(n).values() for f in folders}
        deleted = 0
        for name in (*SCHEMAS, INDEX, ADJACENCY):
            folder, fs = self._fs(f"{self.root}/{name}")
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{name}/{f.getPath().getName()}" not in kept:
                    deleted += bool(fs.delete(f.getPath(), True))
        for n in numbers[:-keep]:
            path, fs = self._fs(f"{self.root}/_versions/{n:012d}.json")
            fs.delete(path, False)
        return deleted

    def _row(self, name: str, row_id: str, seen: Seen | None = None) -> dict[str, Any]:
        found = self.table(name, seen).filter(F.col("id") == row_id).first()
        if found is None:
            raise NotFound(f"{name} {row_id!r} not found")
        return found.asDict(recursive=True)

    def _frame(self, name: str, rows: list[dict[str, Any]]) -> DataFrame:
        columns = T.StructType.fromDDL(SCHEMAS[name]).fieldNames()
        return self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], SCHEMAS[name])

    def _next(self, name: str, seen: Seen) -> int:
        return (self.table(name, seen).agg(F.max("seq")).first()[0] or 0) + 1

    # Sources ----------------------------------------------------------------------------------------------------

    def put_source(self, row: dict[str, Any], new: bool = True) -> dict[str, Any]:
        given = row | {"id": row.get("id") or random_id("src")} if new else row

        def put(seen: Seen) -> None:
            row = ({} if new else self._row("sources", given["id"], seen)) | given
            for need in ("kind", "name", "dsn"):
                if not str(row.get(need) or "").strip():
                    raise ValueError(f"source {need} is required")
            if row["kind"] not in KINDS:
                raise ValueError(f"unsupported source kind {row['kind']!r}")
            try:
                json.loads(row.get("config_json") or "{}")
            except ValueError as e:
                raise ValueError("config_json is not JSON") from e
            blank = {c: "" for c in ("product_hint", "module_hint", "sync_schedule")} | {"config_json": "{}"}
            self.change({"sources": [blank | {"created_at": now()} | row | {"updated_at": now()}]}, seen=seen)

        self.again(put)
        return self._row("sources", given["id"])

    def update_source(self, row: dict[str, Any]) -> dict[str, Any]:
        return self.put_source(row, new=False)

    def sources(self) -> DataFrame:
        return self.table("sources").orderBy(F.desc("created_at"), F.desc("id"))

    def source(self, source_id: str) -> dict[str, Any]:
        return self._row("sources", source_id)

    def delete_source(self, source_id: str) -> None:
        """With its documents, sections, profiles, and nodes and edges that are its own."""

        def delete(seen: Seen) -> None:
            self._row("sources", source_id, seen)
            gone = self.table("documents", seen).filter(F.col("source_id") == source_id).select(F.col("id").alias("document_id"))
            left = {"sources": self.table("sources", seen).filter(F.col("id") != source_id), "broken_links": self.table("broken_links", seen).filter(F.col("source_id") != source_id)}
            self.commit(left | self.without_documents(gone, seen, source_id), seen)

        self.again(delete)

    def without_documents(self, gone: DataFrame, seen: Seen, source_id: str = "") -> dict[str, DataFrame]:
        """The tables without some documents (document_id) and all that hangs on them; with ``source_id`` also without
        that source's products, modules and APIs."""
        documents, sections = self.table("documents", seen), self.table("sections", seen)
        nodes = self.table("nodes", seen).withColumn("document_id", F.coalesce(F.col("metadata")["document_id"], F.lit("")))
        nodes = nodes.join(gone, "document_id", "left_anti").drop("document_id")
        if source_id:
            nodes = nodes.filter(F.coalesce(F.col("metadata")["source_id"], F.lit("")) != source_id)
        kept = sections.join(gone, "document_id", "left_anti")
        return {
            "documents": documents.join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti"), "sections": kept,
            "profiles": self.table("profiles", seen).join(gone, "document_id", "left_anti"), "nodes": nodes, "edges": attached(self.table("edges", seen), nodes, kept),
        }

    # Jobs -------------------------------------------------------------------------------------------------------

    def start_job(self, source_id: str) -> dict[str, Any]:
        """At most one running job of a source: the check and the new row are one change."""
        job_id = random_id("job")

        def start(seen: Seen) -> None:
            if not self.table("jobs", seen).filter((F.col("source_id") == source_id) & (F.col("status") == "running")).isEmpty():
                raise SyncInProgress(f"a sync of {source_id!r} is in progress")
            row = {"id": job_id, "seq": self._next("jobs", seen), "kind": "sync_source", "status": "running", "source_id": source_id, "payload_json": json.dumps({"source_id": source_id}), "attempts": 1, "last_error": "", "created_at": now(), "updated_at": now()}
            self.change({"jobs": [row]}, seen=seen)

        self.again(start)
        return self._row("jobs", job_id)

    def fail_interrupted(self) -> int:
        """At the start of a service: jobs that still run have lost their process, and would block their sources."""

        def fail(seen: Seen) -> int:
            running = self.table("jobs", seen).filter("status = 'running'").collect()  # one for each source at most
            rows = [r.asDict() | {"status": "failed", "last_error": INTERRUPTED, "updated_at": now()} for r in running]
            if rows:
                self.change({"jobs": rows}, seen=seen)
            return len(rows)

        return self.again(fail)

    def end_job(self, job_id: str, payload: dict[str, Any] | None = None, error: str = "") -> dict[str, Any]:
        def end(seen: Seen) -> None:
            row = self._row("jobs", job_id, seen)
            body = json.dumps(json.loads(row["payload_json"]) | (payload or {}), ensure_ascii=False)
            self.change({"jobs": [row | {"status": "failed" if error else "completed", "payload_json": body, "last_error": error, "updated_at": now()}]}, seen=seen)

        self.again(end)
        return self._row("jobs", job_id)

    def jobs(self, source_id: str, limit: int = 20) -> DataFrame:
        return self.table("jobs").filter(F.col("source_id") == source_id).orderBy(F.desc("seq")).limit(limit if 0 < limit <= 100 else 20)

    def delete_job(self, source_id: str, job_id: str) -> None:
        if self._row("jobs", job_id)["source_id"] != source_id:
            raise NotFound(f"job {job_id!r} not found")
        self.again(lambda seen: self.change({"jobs": [{"id": job_id}]}, gone=True, seen=seen))

    def broken_links(self, source_id: str) -> DataFrame:
        """All links that the source's last sync could not resolve, sorted."""
        return self.table("broken_links").filter(F.col("source_id") == source_id).drop("source_id").orderBy("document_id", "section_id", "href", "target")

    # Documents, profiles, graph -----------------------------------------------------------------------------------

    def status(self) -> dict[str, int]:
        if not self.current():
            raise ValueError("the store has no tables yet")
        return {r["name"]: r["n"] for r in graph.status({t: self.table(t) for t in ("sources", "documents", "sections", "nodes", "edges", "jobs")}).collect()}

    def impact_answer(self, node_id: str, direction: str = "out", depth: int = 2, kinds: list[str] | None = None, limit: int = 50) -> dict[str, Any]:
        """The start node and the paths."""
        paths = self.impact(node_id, direction, depth, kinds, limit)
        return {"start_node": self.node(node_id.strip()), "paths": paths}

    def artifacts(self, source_id: str, limit: int = 50, offset: int = 0, after: tuple[str, str] | None = None) -> dict[str, Any]:
        """Numbers, and a page of each kind of what a source has given. after: the title and id of the last document shown,
        in place of an offset for documents."""
        self._row("sources", source_id)
        limit, offset = (limit if 0 < limit <= 200 else 50), max(offset, 0)
        docs = self.table("documents").filter(F.col("source_id") == source_id)
        secs = self.table("sections").join(docs.select(F.col("id").alias("document_id"), F.col("title").alias("document_title")), "document_id")
        own = docs.select(F.col("id").alias("own_document"))
        nodes = self.table("nodes").join(own, F.col("metadata")["document_id"] == F.col("own_document"), "left")
        nodes = nodes.filter((F.col("metadata")["source_id"] == source_id) | F.col("own_document").isNotNull()).drop("own_document")
        ends = nodes.select(F.col("id").alias("end")).distinct()
        edges = self.table("edges")
        edges = graph.one_per_id(edges.join(ends, F.col("src_id") == F.col("end"), "left_semi").unionByName(edges.join(ends, F.col("dst_id") == F.col("end"), "left_semi")))
        page = lambda f, *by: [r.asDict(recursive=True) for r in f.orderBy(*by).offset(offset).limit(limit).collect()]
        counts = graph.status({"documents": docs, "sections": secs, "nodes": nodes, "edges": edges}).collect()
        from lakeleaf.functions.text import snippet_line

        listed = graph.documents_page(docs, secs, limit, 0 if after else offset, after)
        return {
            "counts": {r["name"]: r["n"] for r in counts}, "documents": [r.asDict() for r in listed.collect()],
            "sections": page(secs.select("id", "document_id", "document_title", "title", "heading_path", "ordinal", snippet_line(F.col("content")).alias("snippet")), "document_title", "ordinal", "id"),
            "nodes": page(nodes, "kind", "name", "id"), "edges": page(edges, "kind", "id"),
        }

    def profile(self, document_id: str, seen: Seen | None = None) -> dict[str, Any]:
        self._row("documents", document_id, seen)
        found = self.table("profiles", seen).filter(F.col("document_id") == document_id).first()
        return found.asDict() if found else {"document_id": document_id, "desc": "", "retrieval_profile_json": "{}", "generated_from_hash": ""}

    def put_profile(self, document_id: str, desc: str, profile_json: str | None = None) -> dict[str, Any]:
        given = {"desc": desc}
        if profile_json is not None:
            try:
                json.loads(profile_json)
            except ValueError as e:
                raise ValueError("retrieval_profile_json is not JSON") from e
            given["retrieval_profile_json"] = profile_json
        self.again(lambda seen: self.change({"profiles": [self.profile(document_id, seen) | given]}, seen=seen))
        return self.profile(document_id)

    def put_nodes(self, rows: DataFrame) -> None:
        self.again(lambda seen: self.commit({"nodes": graph.upsert(self.table("nodes", seen), graph.checked_nodes(rows))}, seen))

    def put_edges(self, rows: DataFrame) -> None:
        def put(seen: Seen) -> None:
            own = graph.checked_edges(rows, self.table("nodes", seen))
            self.commit({"edges": graph.upsert(self.table("edges", seen), own)}, seen, {"nodes"})

        self.again(put)

    def node(self, node_id: str) -> dict[str, Any]:
        return self._row("nodes", node_id)

    def section(self, section_id: str) -> dict[str, Any]:
        row = self._row("sections", section_id)
        doc = self._row("documents", row["document_id"])
        return row | {"document_title": doc["title"], "document_url": doc["url"]}

    def search_nodes(self, query: str, limit: int = 20) -> DataFrame:
        return graph.search_nodes(self.table("nodes"), query, limit)

    def adjacency(self) -> Adjacency:
        """The written adjacency of the current nodes and edges. Where single rows were changed since it was last asked
        for, only these are read; where a table was written anew, its rows are compared with the adjacency's."""

        def build(seen: Seen) -> Adjacency:
            folders = {t: seen[1].get(t, []) for t in ("nodes", "edges")}
            (stamp,) = seen[1].get(ADJACENCY_STAMP, ["{}"])
            own, had = Adjacency(self.spark, self.root, seen[1].get(ADJACENCY, [])), json.loads(stamp)
            if had == folders:
                return own
            longer = all(had.get(t) and folders[t][: len(had[t])] == had[t] for t in folders)
            changed = [self._changes(t, folders[t][len(had[t]) :]) for t in folders] if longer else []
            new = own.updated(self.table("nodes", seen), self.table("edges", seen), *changed)
            self._commit(seen, {ADJACENCY: new.names, ADJACENCY_STAMP: [json.dumps(folders)]}, {ADJACENCY})
            return new

        return self.again(build)

    def _changes(self, name: str, folders: list[str]) -> DataFrame:
        """The ids of the rows in folders of changes."""
        if not folders:
            return self._frame(name, []).select("id")
        return self.spark.read.schema("id string").parquet(*[f"{self.root}/{f}" for f in folders])

    def related(self, node_id: str, direction: str = "both", kind: str = "", limit: int = 50) -> DataFrame:
        graph.asked(node_id, direction, "both", "related")
        return graph.related(self.table("nodes"), self.table("edges"), self.table("feedback"), node_id, direction, kind, limit, self.adjacency().rows())

    def impact(self, node_id: str, direction: str = "out", depth: int = 2, kinds: list[str] | None = None, limit: int = 50) -> DataFrame:
        """NotFound if there is no such node."""
        self._row("nodes", graph.asked(node_id, direction, "out", "impact")[0])
        return graph.impact(self.table("nodes"), self.table("edges"), self.table("feedback"), node_id, direction, depth, kinds, limit, self.adjacency().rows())

    # Search -----------------------------------------------------------------------------------------------------

    def index(self) -> Segments:
        """The index of the current sections, titles and profiles. What has changed since it was last asked for is added
        as a segment; of two processes that add one at once the second starts again."""

        def build(seen: Seen) -> Segments:
            stamp = hashlib.sha256(json.dumps([seen[1].get(t) for t in ("documents", "sections", "profiles")]).encode()).hexdigest()
            listed = [x.rsplit(":", 1) for x in seen[1].get(INDEX, [])]
            own = Segments(self.spark, self.root, [name for name, _ in listed], [int(n) for _, n in listed])
            if seen[1].get(STAMP) == [stamp]:
                return own
            read = {t: self.table(t, seen) for t in ("documents", "sections", "profiles")}
            new = own.updated(read["sections"], search.live(read["documents"], read["profiles"], self._frame("feedback", [])))
            self._commit(seen, {INDEX: [f"{name}:{n}" for name, n in zip(new.names, new.sizes, strict=True)], STAMP: [stamp]}, {INDEX})
            return new

        return self.again(build)

    def search(self, options: search.Options) -> search.Result:
        return search.search(options, self.index(), self.table("sections"), self.table("documents"), self.table("profiles"), self.table("feedback"))

    def context(self, request: Request) -> dict[str, Any]:
        r = request.clamped()
        hits = self.search(search.Options.preset(r.query, r.max_sections)).hits
        return {"task": r.task, "query": r.query, "sections": [x.asDict() for x in pack(hits, r).orderBy("place").collect()]}

    # Feedback ---------------------------------------------------------------------------------------------------

    def add_feedback(self, event: dict[str, Any]) -> dict[str, Any]:
        """Append an event; an added relationship or a merge also puts its edge."""
        own = FB.check_event(event) | {"id": random_id("fb"), "created_at": now()}

        def add(seen: Seen) -> None:
            row = own | {"seq": self._next("feedback", seen)}
            changes = {"feedback": [row]}
            if row["feedback_kind"] in ("relationship_add", "node_merge"):
                changes["edges"] = [r.asDict() for r in FB.manual_edges(self._frame("feedback", [row])).select(*graph.EDGE).collect()]  # one event's edge
            self.change(changes, seen=seen)

        self.again(add)
        return self._row("feedback", own["id"])

    def feedback(self, target_kind: str = "", target_id: str = "", feedback_kind: str = "", limit: int = 20) -> DataFrame:
        return FB.list_events(self.table("feedback"), target_kind, target_id, feedback_kind, limit)

    def delete_feedback(self, event_id: str) -> None:
        """What the event hid is seen again; an edge that it put stays."""
        self._row("feedback", event_id)
        self.again(lambda seen: self.change({"feedback": [{"id": event_id}]}, gone=True, seen=seen))


def attached(edges: DataFrame, nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``; evidence that is no section any more is null."""
    for end in ("src_id", "dst_id"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    known = sections.select(F.col("id").alias("known_section"))
    out = edges.join(known, F.col("evidence_section_id") == F.col("known_section"), "left").withColumn("evidence_section_id", F.col("known_section"))
    return out.select(*graph.EDGE)
