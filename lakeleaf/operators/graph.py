"""The property graph: nodes and edges from sources, documents and sections; look-ups, related nodes, impact paths.

nodes: id, kind, name, canonical_name, metadata (map), confidence. edges: id, src_id, dst_id, kind, confidence,
provenance, evidence_section_id, metadata_json.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeleaf.functions import text as X
from lakeleaf.plans.session import written
from lakeleaf.functions.ids import canonical, stable_id
from lakeleaf.operators.feedback import without_wrong

NODE = ("id", "kind", "name", "canonical_name", "metadata", "confidence")
EDGE = ("id", "src_id", "dst_id", "kind", "confidence", "provenance", "evidence_section_id", "metadata_json")
#: A method and a path in text, case-sensitive.
#: The methods and the characters of a path are fixed values.
API_REFERENCE = r"\b(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|TRACE)\s+(/[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%{}-]+)"
DIRECTIONS = ("both", "out", "in")


def document_node_id(doc_id: str | Column = "id") -> Column:
    return stable_id("node", F.lit("document"), F.col(doc_id) if isinstance(doc_id, str) else doc_id)


def section_node_id(section_id: str | Column = "id") -> Column:
    return stable_id("node", F.lit("section"), F.col(section_id) if isinstance(section_id, str) else section_id)


def hint_id(kind: str, source_id: str, hint: str) -> Column:
    return stable_id({"Product": "prd", "Module": "mod"}[kind], F.col(source_id), canonical(hint))


def node_rows(rows: DataFrame, id_: Column, kind: str, name: Column, metadata: dict[str, Column]) -> DataFrame:
    pairs = [x for k in sorted(metadata) for x in (F.lit(k), F.coalesce(metadata[k].cast("string"), F.lit("")))]
    return rows.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), canonical(name).alias("canonical_name"), F.create_map(*pairs).alias("metadata"), F.lit(1.0).alias("confidence"))


def edge_rows(rows: DataFrame, src: Column, dst: Column, kind: str | Column, provenance: str, evidence: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    evidence = F.lit(None).cast("string") if evidence is None else evidence
    rows = rows.select(src.alias("src_id"), dst.alias("dst_id"), kind.alias("kind"), evidence.alias("evidence_section_id"))
    return rows.select(
        stable_id("edge", "src_id", "dst_id", "kind").alias("id"), "src_id", "dst_id", "kind", F.lit(1.0).alias("confidence"), F.lit(provenance).alias("provenance"), "evidence_section_id", F.lit("{}").alias("metadata_json")
    )


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def one_per_id(rows: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row per id: the first in ``order``, by default in the order of all columns. An id has few rows, but for
    API, product and module nodes, whose rows are all alike and are combined before the shuffle."""
    columns = [c for c in rows.columns if c != "id"]
    if order is None:
        plain = [F.map_entries(c).alias(c) if dict(rows.dtypes)[c].startswith("map") else F.col(c) for c in columns]
        least = rows.select("id", F.struct(*plain).alias("v")).groupBy("id").agg(F.min("v").alias("v"))
        back = [F.map_from_entries(F.col("v")[c]).alias(c) if dict(rows.dtypes)[c].startswith("map") else F.col("v")[c].alias(c) for c in columns]
        return least.select("id", *back)
    return rows.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(*order))).filter("r = 1").drop("r")


# Construction ------------------------------------------------------------------------------------------------------


def hint_nodes(sources: DataFrame) -> DataFrame:
    """Products and modules that sources name."""
    frames = []
    for kind, column in (("Product", "product_hint"), ("Module", "module_hint")):
        named = sources.filter(F.trim(F.coalesce(column, F.lit(""))) != "")
        frames.append(node_rows(named, hint_id(kind, "id", column), kind, F.trim(column), {"source_id": F.col("id")}))
    return _all(frames)


def _hinted(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of a source with product_id and module_id (null without a hint). Sources are few and AQE may broadcast them."""
    hint = lambda kind, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", hint_id(kind, "id", c))
    own = sources.select(F.col("id").alias("source_id"), hint("Product", "product_hint").alias("product_id"), hint("Module", "module_hint").alias("module_id"), F.col("kind").alias("source_kind"))
    return rows.join(own, "source_id")


def api_mentions(sections: DataFrame) -> DataFrame:
    """document_id, section_id, method, path of every reference in content and title, once for each section."""
    text = F.concat(F.coalesce("content", F.lit("")), F.lit("\n"), F.coalesce("title", F.lit("")))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(API_REFERENCE), 1).alias("method"), F.regexp_extract_all(text, F.lit(API_REFERENCE), 2).alias("path"))
    rows = sections.select("document_id", F.col("id").alias("section_id"), F.explode(found).alias("r"))
    return rows.select("document_id", "section_id", F.col("r.method").alias("method"), F.regexp_replace("r.path", "[.,;:]+$", "").alias("path")).distinct()


def build_graph(sources: DataFrame, documents: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all documents, one row per id."""
    docs = _hinted(documents, sources)
    doc_node, sec_node = document_node_id("id"), section_node_id("section_id")
    named = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("heading_path"), F.lit("")), F.concat(F.lit("Section "), F.col("ordinal").cast("string")))
    secs = sections.select(F.col("id").alias("section_id"), "document_id", "ordinal", "title", "heading_path", named.alias("name"))
    of_doc = docs.select(F.col("id").alias("document_id"), "source_id", "product_id", "module_id", "source_kind")
    apis = api_mentions(sections).join(of_doc, "document_id").withColumn("api_id", stable_id("api", "source_id", "method", "path"))
    api_name = F.concat_ws(" ", "method", "path")
    nodes = [
        hint_nodes(sources),
        node_rows(docs, doc_node, "Document", F.col("title"), {"document_id": F.col("id"), "source_id": F.col("source_id"), "external_id": F.col("external_id"), "url": F.col("url"), "version": F.col("version")}),
        node_rows(secs, sec_node, "DocSection", F.col("name"), {"document_id": F.col("document_id"), "section_id": F.col("section_id"), "ordinal": F.col("ordinal"), "heading_path": F.col("heading_path")}),
        node_rows(apis, F.col("api_id"), "API", api_name, {"source_id": F.col("source_id"), "method": F.col("method"), "path": F.col("path")}),
    ]
    both = _hinted(sources.withColumn("source_id", F.col("id")).select("source_id"), sources)
    is_spec, api_doc = F.col("source_kind") == "openapi", document_node_id("document_id")
    edges = [
        edge_rows(both.filter("product_id is not null and module_id is not null"), F.col("product_id"), F.col("module_id"), "contains", "source_hint"),
        edge_rows(docs.filter("product_id is not null"), F.col("product_id"), doc_node, "describes", "source_hint"),
        edge_rows(docs.filter("module_id is not null"), F.col("module_id"), doc_node, "describes", "source_hint"),
        edge_rows(secs, document_node_id("document_id"), sec_node, "contains", "sync", F.col("section_id")),
        edge_rows(apis, sec_node, F.col("api_id"), F.when(is_spec, "describes").otherwise("mentions"), "rule", F.col("section_id")),
        edge_rows(apis.filter(is_spec), api_doc, F.col("api_id"), "exposes_api", "rule", F.col("section_id")),
        edge_rows(apis.filter("product_id is not null"), F.col("product_id"), F.col("api_id"), "exposes_api", "rule", F.col("section_id")),
        edge_rows(apis.filter("module_id is not null"), F.col("module_id"), F.col("api_id"), "exposes_api", "rule", F.col("section_id")),
    ]
    return one_per_id(_all(nodes)), one_per_id(_all(edges))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows replace ``old`` ones with the same id; of several new rows with a seq the last counts."""
    if "seq" in new.columns:
        new = one_per_id(new, [F.desc("seq")])
        new = new if "seq" in old.columns else new.drop("seq")
    return old.select(*new.columns).join(new.select("id"), "id", "left_anti").unionByName(new)


def checked_nodes(rows: DataFrame) -> DataFrame:
    """Trimmed; without rows that lack id, kind or name; defaults filled in."""
    rows = rows.withColumns({c: F.trim(c) for c in ("id", "kind", "name", "canonical_name")}).filter("id <> '' and kind <> '' and name <> ''")
    rows = rows.withColumn("canonical_name", F.coalesce(F.nullif("canonical_name", F.lit("")), F.lower("name")))
    return rows.withColumn("confidence", F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(F.lit(1.0)))


def checked_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Trimmed, defaults filled in, both ends known."""
    rows = rows.withColumns({c: F.trim(c) for c in ("id", "src_id", "dst_id", "kind")}).filter("id <> '' and src_id <> '' and dst_id <> '' and kind <> ''")
    rows = rows.withColumn("provenance", F.coalesce(F.nullif(F.trim("provenance"), F.lit("")), F.lit("rule"))).withColumn("evidence_section_id", F.nullif("evidence_section_id", F.lit("")))
    rows = rows.withColumn("confidence", F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(F.lit(1.0)))
    for end in ("src_id", "dst_id"):
        rows = rows.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return rows


def link_targets(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """key, section_id. ``path#anchor`` of each section anchor; the first section of a document also answers to
    ``path#`` and to page anchors that no section has. sections: with anchors; documents: with page_anchors."""
    paths = documents.select(F.col("id").alias("document_id"), F.col("external_id").alias("path"), "page_anchors")
    rows = sections.select("document_id", F.col("id").alias("section_id"), "ordinal", "anchors").join(paths, "document_id")
    own = rows.select("path", F.explode("anchors").alias("anchor"), "section_id", F.lit(1).alias("rank"), "ordinal")
    first = rows.groupBy("document_id", "path").agg(F.min_by("section_id", "ordinal").alias("section_id"), F.first("page_anchors").alias("page_anchors"))
    anchors = F.concat(F.array(F.lit("")), F.coalesce("page_anchors", F.array().cast("array<string>")))
    whole = first.select("path", F.explode(anchors).alias("anchor"), "section_id", F.lit(0).alias("rank"), F.lit(0).alias("ordinal"))
    # A section's own anchor beats the page's; of two sections with one anchor the later one counts.
    return own.unionByName(whole).groupBy(F.concat("path", F.lit("#"), "anchor").alias("key")).agg(F.max_by("section_id", F.struct("rank", "ordinal", "section_id")).alias("section_id"))


#: Keys that a sketch of the links follows, and how many it tells of. A key is heavy with one in HEAVY of all links.
SKETCHED, TOLD, HEAVY = 4096, 256, 400


def heavy_keys(rows: DataFrame, key: str = "key") -> list[str]:
    """The keys with at least one in HEAVY of the rows (and maybe a few more), by a sketch of frequent items, which is
    summed up in each task first. There are at most TOLD of them; no other key has more than that share."""
    found = rows.agg(F.expr(f"approx_top_k({key}, {TOLD}, {SKETCHED})").alias("top"), F.count(key).alias("n")).first()
    return sorted(t["item"] for t in found["top"] if t["item"] is not None and t["count"] * HEAVY >= found["n"])


def join_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (with key, which may be null) with target_id where a target has the key. Every page of a site links to its
    start page: rows of heavy keys stay where they are and meet these keys' few targets by broadcast, as do those
    without a key; the others are shuffled by key, of which none has many rows."""
    named, heavy = targets.withColumnRenamed("section_id", "target_id"), heavy_keys(rows)
    stays = F.col("key").isNull() | (X.one_of("key", heavy) if heavy else F.lit(False))
    hot = rows.filter(stays).join(F.broadcast(named.filter(X.one_of("key", heavy))), "key", "left")  # TOLD rows at most
    return hot.unionByName(rows.filter(~stays).join(named, "key", "left"))


def resolve_links(links: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links: document_id, section_id, href, text, candidates (keys in order of preference). targets: one for each key.

    Edges links_to (own section aside), and broken links (document_id, section_id, href, target), each once, sorted.
    """
    rows = written(links.select("document_id", "section_id", "href", "candidates"), "links")  # read by the sketch and twice by the join
    met = join_targets(rows.select("*", F.posexplode_outer("candidates").alias("pos", "key")), targets)
    best = met.groupBy("document_id", "section_id", "href", F.get("candidates", F.lit(0)).alias("target")).agg(F.min_by("target_id", F.when(F.col("target_id").isNotNull(), F.col("pos"))).alias("target_id"))
    found = best.filter(F.col("target_id").isNotNull() & (F.col("target_id") != F.col("section_id")))
    edges = one_per_id(edge_rows(found, section_node_id("section_id"), section_node_id("target_id"), "links_to", "html_link", F.col("section_id")))
    broken = best.filter(F.col("target_id").isNull()).select("document_id", "section_id", "href", "target").distinct().orderBy("document_id", "section_id", "href", "target")
    return edges, broken


# Queries -------------------------------------------------------------------------------------------------------------


def search_nodes(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Nodes with the text in any field (``%`` and ``_`` are wildcards): exact id, exact name, others; kind, name, id."""
    query = query.strip()
    if not query:
        return nodes.limit(0)
    metadata = F.to_json("metadata") if dict(nodes.dtypes).get("metadata", "").startswith("map") else F.col("metadata")
    tests = [X.like_ascii_fold(c, query) for c in (F.col("id"), F.col("kind"), F.col("name"), F.col("canonical_name"), metadata)]
    rank = F.when(F.col("id") == query, 0).when(X.ascii_lower(F.col("name")) == query.translate(str.maketrans(X.UPPER, X.LOWER)), 1).otherwise(2)
    return nodes.filter(reduce(Column.__or__, tests)).withColumn("match_rank", rank).orderBy("match_rank", "kind", "name", "id").limit(limit if 0 < limit <= 100 else 20)


def get_row(table: DataFrame, row_id: str) -> DataFrame:
    return table.filter(F.col("id") == row_id)


def adjacency(nodes: DataFrame, edges: DataFrame, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """from_id, branch (0 out, 1 in), src_id, edge_id, edge_kind, node_id, node_kind, node_canonical, node_name: a row for
    each edge and end that a step may start from. Written sorted by from_id, it answers ``related`` and ``impact`` from
    the row groups of the asked nodes."""
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    frames = []
    for branch, (here, there) in enumerate((("src_id", "dst_id"), ("dst_id", "src_id"))):
        if direction in ("both", ("out", "in")[branch]):
            frames.append(edges.select(F.col(here).alias("from_id"), F.lit(branch).alias("branch"), "src_id", F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), F.col(there).alias("node_id")))
    to = nodes.select(F.col("id").alias("node_id"), F.col("kind").alias("node_kind"), F.col("canonical_name").alias("node_canonical"), F.col("name").alias("node_name"))
    return _all(frames).join(to, "node_id")


def write_adjacency(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """As many files as the shuffle has partitions; a hub's rows may take several."""
    adjacency(nodes, edges).repartitionByRange("from_id", "branch", "edge_id").sortWithinPartitions("from_id", "branch", "edge_kind", "edge_id").write.mode("overwrite").parquet(path)
    return nodes.sparkSession.read.parquet(path)


STEP_ORDER = ("branch", "edge_kind", "node_kind", "node_canonical", "edge_id")


def asked(node_id: str, direction: str, default: str, what: str) -> tuple[str, str]:
    """The trimmed id and the direction's name; errors for a blank id and an unknown direction."""
    node_id, name = node_id.strip(), direction.strip().lower() or default
    if not node_id:
        raise ValueError("a node id is required")
    if name not in DIRECTIONS:
        raise ValueError(f"unsupported {what} direction {direction!r}")
    return node_id, name


def _steps_from(ids: list[str], nodes: DataFrame, edges: DataFrame, feedback: DataFrame, direction: str, kinds: list[str] | None, written: DataFrame | None) -> DataFrame:
    """Steps that start at some nodes (few); their filter reaches the scan of the edges or of the written adjacency."""
    if written is None:
        ends = {"out": [F.col("src_id")], "in": [F.col("dst_id")], "both": [F.col("src_id"), F.col("dst_id")]}[direction]
        near = edges.filter(reduce(Column.__or__, [c.isin(*ids) for c in ends]))
        rows = adjacency(nodes, near, direction, kinds)
    else:
        rows = written.filter(F.col("branch").isin({"out": [0], "in": [1], "both": [0, 1]}[direction]))
        rows = rows.filter(F.col("edge_kind").isin(*kinds)) if kinds else rows
    return without_wrong(rows.filter(F.col("from_id").isin(*ids)), feedback, "edge_id")


def related(nodes: DataFrame, edges: DataFrame, feedback: DataFrame, node_id: str, direction: str = "both", kind: str = "", limit: int = 50, written: DataFrame | None = None) -> DataFrame:
    """Neighbours of a node: outgoing first, incoming fill what is left of the limit. direction: out if the edge starts
    at the node, so a loop is out in both branches. written: of ``write_adjacency`` or
    ``Adjacency``, if there is one; of the latter the node's first blocks are enough where nothing is filtered out."""
    node_id, direction = asked(node_id, direction, "both", "related")
    limit = limit if 0 < limit <= 100 else 50

    def first(known: DataFrame | None) -> DataFrame:
        rows = _steps_from([node_id], nodes, edges, feedback, direction, [kind] if kind else None, known)
        rows = rows.withColumn("direction", F.when(F.col("src_id") == node_id, "out").otherwise("in")).drop("src_id", "block")
        return rows.orderBy(*STEP_ORDER).limit(limit)

    if written is None or "block" not in written.columns:
        return first(written)
    block = first(written.filter("block = 0"))
    held = block.collect()  # 100 rows at most
    if len(held) < limit and not written.filter((F.col("from_id") == node_id) & (F.col("block") == 1)).isEmpty():
        return first(written)
    return nodes.sparkSession.createDataFrame(held, block.schema)


PATHS = "hops int, path_nodes array<string>, path_edges array<string>, order array<int>, from_id string"


def impact(nodes: DataFrame, edges: DataFrame, feedback: DataFrame, node_id: str, direction: str = "out", depth: int = 2, kinds: list[str] | None = None, limit: int = 50, written: DataFrame | None = None) -> DataFrame:
    """Simple paths from a node, breadth first: hops, path_nodes, path_edges, place.

    Every prefix of a path is a result too. Each expansion takes the first ``cap`` neighbours of ``related``, whose
    limit is this one's, and 50 where that is over 100. Hops are run one after the other, each from the at most
    ``limit`` (200) paths of the one before, whose ends filter the edges; nothing is worked out twice. The loop ends at
    ``depth`` (5 at most), or when the limit is filled or no path goes on.
    """
    node_id, direction = asked(node_id, direction, "out", "impact")
    depth, limit = (depth if 1 <= depth <= 5 else 2), (limit if 1 <= limit <= 200 else 50)
    cap = limit if limit <= 100 else 50
    spark = nodes.sparkSession
    known = not nodes.filter(F.col("id") == node_id).isEmpty()
    frontier, found = [(0, [node_id], [], [], node_id)] if known else [], []
    for hop in range(1, depth + 1):
        if not frontier or len(found) >= limit:
            break
        steps = _steps_from(sorted({p[4] for p in frontier}), nodes, edges, feedback, direction, kinds, written)
        ranked = steps.withColumn("rank", F.row_number().over(W.partitionBy("from_id").orderBy(*STEP_ORDER))).filter(F.col("rank") <= cap)
        near = F.broadcast(spark.createDataFrame(frontier, PATHS)).join(ranked, "from_id").filter(~F.array_contains("path_nodes", F.col("node_id")))
        near = near.select(
            F.lit(hop).alias("hops"), F.array_append("path_nodes", F.col("node_id")).alias("path_nodes"), F.array_append("path_edges", F.col("edge_id")).alias("path_edges"), F.array_append("order", F.col("rank")).alias("order"), F.col("node_id").alias("from_id")
        )
        frontier = [tuple(r) for r in near.orderBy("order").limit(limit - len(found)).collect()]  # at most 200 rows
        found += frontier
    rows = [(hops, path_nodes, path_edges, place + 1) for place, (hops, path_nodes, path_edges, _, _) in enumerate(found)]
    return spark.createDataFrame(rows, "hops int, path_nodes array<string>, path_edges array<string>, place int")


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: row counts in one job."""
    return _all([t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def artifact_counts(documents: DataFrame, sections: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """By source_id: documents, sections (and nodes, distinct edges touching any of them)."""
    secs = documents.select("source_id", F.col("id").alias("document_id")).join(sections.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "left")
    out = secs.groupBy("source_id").agg(F.count("*").alias("documents"), F.sum(F.coalesce("n", F.lit(0))).alias("sections"))
    if nodes is not None and edges is not None:
        own = nodes.withColumn("source_id", F.coalesce(F.col("metadata")["source_id"], F.lit("")))
        by_doc = documents.select(F.col("id").alias("doc_key"), F.col("source_id").alias("doc_source"))
        own = own.withColumn("doc_key", F.col("metadata")["document_id"]).join(by_doc, "doc_key", "left").withColumn("source_id", F.coalesce(F.nullif("source_id", F.lit("")), "doc_source"))
        own = own.select("id", "source_id")
        touching = _all([edges.select(F.col("id").alias("edge_id"), F.col(end).alias("id")).join(own, "id").select("source_id", "edge_id") for end in ("src_id", "dst_id")])
        out = out.join(own.groupBy("source_id").agg(F.count("*").alias("nodes")), "source_id", "left").join(touching.groupBy("source_id").agg(F.countDistinct("edge_id").alias("edges")), "source_id", "left").na.fill(0)
    return out


def beyond(rows: DataFrame, by: tuple[str, ...], after: tuple | None) -> DataFrame:
    """The rows after a place in the order of some columns; all without one."""
    if after is None:
        return rows
    return rows.filter(F.struct(*[F.col(c) for c in by]) > F.struct(*[F.lit(v).alias(c) for c, v in zip(by, after, strict=True)])).filter(F.col(by[0]) >= after[0])


def documents_page(documents: DataFrame, sections: DataFrame, limit: int = 50, offset: int = 0, after: tuple[str, str] | None = None) -> DataFrame:
    """Documents with their numbers of sections, by title then id, one page: from an offset, or after the (title, id) of the
    last one, which costs the same however far it is. Sections are counted for the page's documents only."""
    rows = beyond(documents.select("id", "title"), ("title", "id"), after).orderBy("title", "id")
    page = rows.offset(max(offset, 0)).limit(limit if 0 < limit <= 200 else 50)
    own = F.broadcast(page.select(F.col("id").alias("document_id")))  # 200 rows at most
    counts = sections.join(own, "document_id", "left_semi").groupBy("document_id").agg(F.count("id").alias("sections"))
    out = page.join(counts, page["id"] == counts["document_id"], "left").select(page["id"], "title", F.coalesce("sections", F.lit(0)).alias("sections"))
    return out.orderBy("title", "id")
