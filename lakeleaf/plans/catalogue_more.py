"""More of the engine's queries: parsers, patterns, the graph of documents, the store, packs. Where the driver's tables
hold no such documents, these are made from their rows, and the SQL says what must come out."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeleaf.functions import text as X
from lakeleaf.operators import context, graph, profiles, search
from lakeleaf.plans import adapters as A
from lakeleaf.plans import sync
from lakeleaf.plans.catalogue import PHRASE, REFS_SQL, SAID_SQL, TOKENS, _index, bm25_sql, query, stable_sql, tokens_sql
from lakeleaf.plans.session import shared_dir
from lakeleaf.plans.store import Store
from lakeleaf.streaming.flags import EVENTS, follow_flags, live_flags
from lakeleaf.sources import folders, globs, markdown, openapi, paths, web


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


# Parsers -----------------------------------------------------------------------------------------------------------------

BODY_SQL = "replace(coalesce(text, ''), '#', '+') || chr(10)"


@query(
    f"""
    with d as (select 'a/doc' || doc_id || '.md' as path, 'Title ' || doc_id as t, 'Part ' || coalesce(source, '') as p, 'intro ' || coalesce(lang, '') || chr(10) || chr(10) as intro, {BODY_SQL} as body from documents),
    s as (select path, t, 0 as ordinal, t as title, t as heading_path, intro as content from d
          union all select path, t, 1, p, t || ' > ' || p, body from d
          union all select path, t, 2, 'Deep #1', t || ' > ' || p || ' > Deep #1', '####### seven' || chr(10) || '    # indented' || chr(10) || '#none' || chr(10) from d
          union all select path, t, 3, '', '', 'last' || chr(10) from d)
    select path, t as document_title, ordinal, title, heading_path, content, sha256(content) as hash from s
    """
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of several levels, closed, skipped, empty and false ones, around every text."""
    d = A.read(spark, sf_dir, "documents")
    doc_id = F.col("doc_id").cast("string")
    content = F.concat(F.lit("# Title "), doc_id, F.lit("\nintro "), _text("lang"), F.lit("\n\n  ## Part "), _text("source"), F.lit(" ##  \n"), F.replace(_text("text"), F.lit("#"), F.lit("+")), F.lit("\n#### Deep #1 ###\n####### seven\n    # indented\n#none\n#\nlast\n"))
    rows = d.select(F.concat(F.lit("a/doc"), doc_id, F.lit(".md")).alias("path"), F.encode(content, "utf-8").alias("content"))
    s = folders.parsed(rows, markdown.parse).select("path", F.col("title").alias("document_title"), F.explode("sections").alias("s"))
    return s.select("path", "document_title", "s.ordinal", "s.title", F.array_join("s.heading_path", " > ").alias("heading_path"), "s.content", "s.hash")


@query("select 'n/doc' || doc_id || '.TXT' as path, 'doc' || doc_id || '.TXT' as title, coalesce(text, '') as content, sha256(coalesce(text, '')) as hash from documents")
def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text by its ending; white space around it goes."""
    d = A.read(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("n/doc"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("path"), F.encode(F.concat(F.lit("\n  "), _text("text"), F.lit(" \n\n")), "utf-8").alias("content"))
    s = folders.parsed(rows, folders.parse_static)
    return s.select("path", "title", F.col("sections")[0]["content"].alias("content"), "hash")


@query(
    """
    with n as (select n_nationkey as k, n_name as name from nation),
    s as (select k, 0 as ordinal, 'GET /n/' || k as title,
                 'GET /n/' || k || chr(10) || 'operationId: get' || k || chr(10) || 'tags: t, u' || chr(10) || 'summary: Read ' || name || chr(10) || 'parameters:' || chr(10) || '- q in query required schema: string date' || chr(10)
                 || 'responses:' || chr(10) || '- 200 fine' || chr(10) || '  content application/json schema: Row object a row' || chr(10) || '- 404' || chr(10) as content from n
          union all select k, 1, 'POST /n/' || k, 'POST /n/' || k || chr(10) || 'description: Put ' || name || chr(10) || 'requestBody: required' || chr(10) || '  content application/json schema: array items integer' || chr(10) from n)
    select 'api' || k || '.json' as path, ordinal, title, replace(content, '  content', ' content') as content from s
    """
)
def openapi_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification for each nation."""
    spec = json.dumps({
        "openapi": "3.0.0", "info": {"title": "API"}, "components": {"schemas": {"Row": {"type": "object", "description": "a row"}}},
        "paths": {"/n/@k": {
            "post": {"description": "Put @name", "requestBody": {"required": True, "content": {"application/json": {"schema": {"type": "array", "items": {"type": "integer"}}}}}},
            "get": {"operationId": "get@k", "tags": ["t", "u"], "summary": "Read @name", "parameters": [{"name": "q", "in": "query", "required": True, "schema": {"type": "string", "format": "date"}}],
                    "responses": {"404": {}, "200": {"description": "fine", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Row"}}}}}},
        }},
    })
    n = A.read(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    content = F.replace(F.replace(F.lit(spec), F.lit("@k"), key), F.lit("@name"), F.col("n_name"))
    s = folders.parsed(n.select(F.concat(F.lit("api"), key, F.lit(".json")).alias("path"), F.encode(content, "utf-8").alias("content")), openapi.parse)
    s = s.select("path", F.explode("sections").alias("s")).select("path", "s.ordinal", "s.title", "s.content")
    return s.withColumn("content", F.regexp_replace("content", r"(?m)^\s*content", " content"))


# Paths and patterns ------------------------------------------------------------------------------------------------------


@query(
    """
    select path from (select case when doc_id % 11 = 0 then '.git/' when doc_id % 13 = 0 then 'x/node_modules/' else '' end || source || '/' || lang || '/doc' || doc_id
                             || case doc_id % 4 when 0 then '.md' when 1 then '.txt' when 2 then '.markdown' else '.pdf' end as path from documents)
    where (ends_with(path, '.md') or starts_with(path, 'src3/')) and not contains(path, '/fr/') and not starts_with(path, '.git/') and not contains(path, 'node_modules/') and not regexp_matches(path, '/doc1[0-9]*5\\.txt$')
    """
)
def wanted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that patterns take and leave out, tested inside Spark."""
    d = A.read(spark, sf_dir, "documents")
    own = globs.Patterns.of({"include": ["**/*.md", "src3/**"], "exclude": "**/fr/**, **/doc1*5.txt"})
    above = F.when(F.col("doc_id") % 11 == 0, ".git/").when(F.col("doc_id") % 13 == 0, "x/node_modules/").otherwise("")
    ends = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".markdown", ".pdf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(above, F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), ends)
    return d.select(path.alias("path")).filter(own.column(F.col("path")))


@query(
    """
    with u as (select page_id, regexp_replace(url, '[?#].*$', '') as page, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) as path from pages)
    select page_id, page, starts_with(path, '/en/') or path = '/en' as in_scope,
           case when contains(regexp_extract(trim(path, '/'), '[^/]*$'), '.') then trim(path, '/') else trim(path, '/') || '/index.html' end as document_path from u
    """
)
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address without query and fragment, whether it lies under /en, and its document's path."""
    pages = A.read(spark, sf_dir, "pages").select("page_id", "url")

    def run(batches):
        for batch in batches:
            page = batch["url"].map(web.page_url)
            yield batch[["page_id"]].assign(page=page, in_scope=page.map(lambda u: web.in_scope("/" + u.split("/", 3)[3], "/en")), document_path=page.map(lambda u: web.document_path("/", u)))

    return pages.mapInPandas(run, "page_id long, page string, in_scope boolean, document_path string")


@query(
    """
    select page_id, 'https://x.example/base/' || p as url, '/srv/docs/' || p as local_url, list_sort(list_distinct(['en/' || p || '#top', 'en/' || p || '/index.html#top', 'en/' || p || '.html#top', p || '#top', p || '/index.html#top', p || '.html#top'])) as candidates
    from (select page_id, 'page' || page_id as p from pages)
    """
)
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a link from en/index.html may lead, and documents' addresses under two prefixes."""
    pages = A.read(spark, sf_dir, "pages").select("page_id")

    def run(batches):
        for batch in batches:
            name = "page" + batch["page_id"].astype(str)
            found = name.map(lambda p: sorted(paths.href_candidates("en/index.html", f"./{p}?q=1#top".replace("?q=1#top", "#top"))))
            yield batch.assign(url=name.map(lambda p: paths.document_url("https://x.example/base/", p)), local_url=name.map(lambda p: paths.document_url("/srv/docs", p)), candidates=found)

    return pages.mapInPandas(run, "page_id long, url string, local_url string, candidates array<string>")


@query("select doc_id, list_transform(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, greatest(length(h) - n + 2, 1)), lambda i: substr(h, i, n)))), lambda g: g) as grams from (select doc_id, translate(doc_id::varchar, '0123456789', '零一二三四五六七八九') || '接口' as h from documents)")
def han_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams of ids spelt in Han signs, between other words."""
    said = F.concat(F.lit("doc "), F.translate(F.col("doc_id").cast("string"), "0123456789", "零一二三四五六七八九"), F.lit("接口 end"))
    return A.read(spark, sf_dir, "documents").select("doc_id", X.han_ngrams(said, 2, 4).alias("grams"))


# The graph of documents ----------------------------------------------------------------------------------------------------

DOC_NODE, SEC_NODE = stable_sql("node", "'document'", "doc"), stable_sql("node", "'section'", "doc")
#: Sources: of src0 to src4 specifications; products of even ones, modules of those that 3 divides.
GRAPH_SQL = f"""
    src as (select distinct source as s, try_cast(source[4:] as int) as n from documents where source is not null),
    sources as (select s, case when n < 5 then 'openapi' else 'static' end as kind, case when n % 2 = 0 then {stable_sql("prd", "s", "'product  of ' || s").replace("product  of", "product of")} end as product, case when n % 3 = 0 then {stable_sql("mod", "s", "'module ' || s")} end as module from src),
    d as (select doc_id::varchar as doc, sources.*, {DOC_NODE.replace("(doc)", "(doc_id::varchar)")} as doc_node, {SEC_NODE.replace("(doc)", "(doc_id::varchar)")} as sec_node, {SAID_SQL} as said from documents join sources on source = s),
    refs as (select distinct doc, s, kind, product, module, doc_node, sec_node, method, regexp_replace(path, '[.,;:]+$', '') as path from (select *, unnest(regexp_extract_all(said, {REFS_SQL}, 1)) as method, unnest(regexp_extract_all(said, {REFS_SQL}, 2)) as path from d)),
    apis as (select *, {stable_sql("api", "s", "method", "path")} as api from refs),
    nodes as (select product as id, 'Product' as kind, 'Product  of ' || s as name, s as source_id, '' as document_id from sources where product is not null
              union all select module, 'Module', 'Module ' || s, s, '' from sources where module is not null
              union all select doc_node, 'Document', 'doc' || doc, s, doc from d
              union all select sec_node, 'DocSection', 'doc' || doc, '', doc from d
              union all select distinct api, 'API', method || ' ' || path, s, '' from apis),
    links as (select product as a, module as b, 'contains' as kind, 'source_hint' as provenance, null as evidence from sources
              union all select product, doc_node, 'describes', 'source_hint', null from d union all select module, doc_node, 'describes', 'source_hint', null from d
              union all select doc_node, sec_node, 'contains', 'sync', doc from d
              union all select sec_node, api, case when kind = 'openapi' then 'describes' else 'mentions' end, 'rule', doc from apis
              union all select doc_node, api, 'exposes_api', 'rule', doc from apis where kind = 'openapi'
              union all select product, api, 'exposes_api', 'rule', doc from apis union all select module, api, 'exposes_api', 'rule', doc from apis),
    edges as (select {stable_sql("edge", "a", "b", "kind")} as id, a as src_id, b as dst_id, kind, any_value(provenance) as provenance, min(evidence) as evidence_section_id from links where a is not null and b is not null group by all)
""".replace("group by all)\n", "group by a, b, kind)\n")


def _document_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = A.documents(spark, sf_dir).filter("source_id is not null").withColumn("version", F.lit(""))
    secs = A.documents_with_references(spark, sf_dir).join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    number = F.expr("try_cast(substring(id, 4) as int)")
    src = docs.select(F.col("source_id").alias("id")).distinct()
    src = src.select(
        "id", F.when(number < 5, "openapi").otherwise("static").alias("kind"), F.when(number % 2 == 0, F.concat(F.lit(" Product  of "), "id")).alias("product_hint"), F.when(number % 3 == 0, F.concat(F.lit("Module "), "id")).otherwise(" ").alias("module_hint")
    )
    return docs, secs, *graph.build_graph(src, docs, secs)


@query(f"with {GRAPH_SQL} select id, kind, name, regexp_replace(lower(name), '\\s+', ' ', 'g') as canonical_name, source_id, document_id from nodes")
def document_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, nodes, _ = _document_graph(spark, sf_dir)
    of = lambda k: F.coalesce(F.col("metadata")[k], F.lit("")).alias(k)
    return nodes.select("id", "kind", "name", "canonical_name", of("source_id"), of("document_id"))


@query(f"with {GRAPH_SQL} select id, src_id, dst_id, kind, provenance, evidence_section_id from edges")
def document_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, edges = _document_graph(spark, sf_dir)
    return edges.select("id", "src_id", "dst_id", "kind", "provenance", "evidence_section_id")


@query(
    f"""
    with {GRAPH_SQL},
    own as (select nodes.id, coalesce(nullif(source_id, ''), s) as source_id from nodes left join d on document_id = doc),
    touching as (select distinct source_id, edges.id from edges join own on own.id in (src_id, dst_id))
    select * from (select s as source_id, count(*) as documents, count(*)::bigint as sections from d group by s) join (select source_id, count(*) as nodes from own group by 1) using (source_id) join (select source_id, count(*) as edges from touching group by 1) using (source_id)
    """.replace("join own on own.id in (src_id, dst_id))", "join own on own.id = src_id union select distinct source_id, edges.id from edges join own on own.id = dst_id)")
)
def source_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.artifact_counts(*_document_graph(spark, sf_dir))


@query(
    f"""
    with {GRAPH_SQL},
    given as (select ' ' || id || ' ' as id, case when kind = 'API' then '' else kind end as kind, name, case when kind = 'Document' then '' else upper(name) end as canonical_name, case when kind = 'Module' then 0.5 else 0 end::double as confidence from nodes)
    select trim(id) as id, kind, trim(name) as name, case when trim(canonical_name) = '' then lower(trim(name)) else trim(canonical_name) end as canonical_name, case when confidence > 0 then confidence else 1 end::double as confidence from given where kind <> ''
    """
)
def checked_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as a caller may give them: blanks around ids, no kind (refused), no canonical name, no confidence."""
    _, _, nodes, _ = _document_graph(spark, sf_dir)
    given = nodes.withColumns({
        "id": F.concat(F.lit(" "), "id", F.lit(" ")), "canonical_name": F.when(F.col("kind") == "Document", "").otherwise(F.upper("name")),
        "confidence": F.when(F.col("kind") == "Module", F.lit(0.5)).otherwise(F.lit(0.0)), "kind": F.when(F.col("kind") == "API", "").otherwise(F.col("kind")),
    })
    return graph.checked_nodes(given).select("id", "kind", "name", "canonical_name", "confidence")


@query(f"with {GRAPH_SQL} select e.id, kind, case when kind = 'contains' then 'rule' else provenance end as provenance from edges e where src_id in (select id from nodes where kind <> 'Module') and dst_id in (select id from nodes where kind <> 'Module')")
def checked_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends among the nodes that are not modules; a blank provenance is a rule's."""
    _, _, nodes, edges = _document_graph(spark, sf_dir)
    given = edges.withColumn("provenance", F.when(F.col("kind") == "contains", " ").otherwise(F.col("provenance")))
    return graph.checked_edges(given, nodes.filter("kind <> 'Module'")).select("id", "kind", "provenance")


@query(
    """
    with p as (select page_id, 'p' || page_id as name, max(page_id) over () as last from pages),
    e as (select name, href, case href when 'self' then name || '-0' when 'next' then 'p' || (page_id + 1) || '-1' when 'query' then 'p' || (page_id + 1) || '-0' when 'root' then 'p0-0' end as target from p, (values ('self'), ('next'), ('query'), ('root')) h(href))
    select distinct name || '-1' as section_id, target as target_id from e where target <> name || '-1' and (exists (select 1 from p where p.name || '-1' = target or p.name || '-0' = target))
    """
)
def page_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead to a page's own first section, to an anchor of the next page, with a query (which takes the anchor
    with it) to the next page, and to the first page from the root."""
    p = A.read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"))
    none = F.array().cast("array<string>")
    docs = p.select(F.col("name").alias("id"), F.concat(F.lit("d/"), "name", F.lit(".html")).alias("external_id"), none.alias("page_anchors"))
    link = lambda h: F.struct(h.alias("href"), F.lit("").alias("text"))
    links = F.array(link(F.concat("name", F.lit(".html"))), *[link(F.concat(F.lit("./p"), (F.col("page_id") + 1).cast("string"), F.lit(f".html{end}"))) for end in ("#second", "?x=1#second")], link(F.lit("/d/p0.html")))
    first = p.select(F.concat("name", F.lit("-0")).alias("id"), F.col("name").alias("document_id"), F.lit(0).alias("ordinal"), none.alias("anchors"), F.filter(links, lambda x: F.lit(False)).alias("links"))
    second = p.select(F.concat("name", F.lit("-1")).alias("id"), F.col("name").alias("document_id"), F.lit(1).alias("ordinal"), F.array(F.lit("second")).alias("anchors"), links.alias("links"))
    secs = first.unionByName(second)
    edges, _ = graph.resolve_links(sync.page_links(docs, secs), graph.link_targets(docs, secs))
    ids = secs.select("id", graph.section_node_id("id").alias("dst_id"))
    return edges.select(F.col("evidence_section_id").alias("section_id"), "dst_id").join(ids, "dst_id").select("section_id", F.col("id").alias("target_id"))


# Profiles, plans of a search, packs --------------------------------------------------------------------------------------------


@query(
    f"""
    with r as (select doc_id, list_sort(list_distinct(list_filter([case when regexp_full_match(w, '[1-5][0-9][0-9]') then w when starts_with(w, '/') then w end for w in regexp_extract_all(lower('doc' || doc_id || chr(10) || 'doc' || doc_id || chr(10) || body), '[a-z0-9/_.\\-]+')], lambda x: x is not null)))[1:40] as refs
               from (select doc_id, 'see get ' || '/docs/' || doc_id || ' for ' || (doc_id % 500 + 100) as body from documents))
    select doc_id::varchar as document_id, ['GET /docs/' || doc_id] || list_filter(refs, lambda x: true) as api_refs from r
    """
)
def profile_api_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of sections made from the ids: a method with its path, the path alone, and a status code."""
    doc_id = F.col("doc_id").cast("string")
    said = F.concat(F.lit("see get /docs/"), doc_id, F.lit(" for "), (F.col("doc_id") % 500 + 100).cast("string"))
    name = F.concat(F.lit("doc"), doc_id)
    rows = A.read(spark, sf_dir, "documents").select(doc_id.alias("document_id"), doc_id.alias("id"), name.alias("title"), name.alias("heading_path"), said.alias("content"))
    refs = profiles.statistics(rows.select("id", "title"), rows.withColumn("ordinal", F.lit(0)))
    return refs.select("document_id", F.concat(F.filter("api_refs", lambda r: F.startswith(r, F.lit("GET "))), F.filter("api_refs", lambda r: ~F.startswith(r, F.lit("GET ")))).alias("api_refs"))


@query("select doc_id::varchar as document_id, array_to_string(list_distinct_in_order, '|') as names from (select doc_id, ['doc' || doc_id, 'doc' || doc_id || '.txt'] as list_distinct_in_order from documents)")
def profile_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a document goes by: trimmed, without blanks and repeats, in order."""
    d = A.documents(spark, sf_dir)
    padded = F.concat(F.lit("  "), F.col("title"), F.lit("\n"))
    return d.select(F.col("id").alias("document_id"), F.array_join(X.non_empty(padded, F.col("external_id"), F.col("url"), F.col("title")), "|").alias("names"))


PLANS_SQL = f"""
    with f as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0b\\f]+')[1:3] as f from documents),
    q as (select doc_id, f, array_to_string(f, ' ') as q, list_filter(list_transform(f, lambda x: trim(x, '{X.EDGES.replace("'", "''")}')), lambda x: x <> '') as w from f where len(f) > 0),
    l as (select *, [lower(q)] || list_transform(w, lambda x: lower(x)) as low from q),
    t as (select *, list_filter(low, lambda x, i: list_position(low, x) = i and (length(x) >= 2 or regexp_matches(x, '[/_-]'))) as terms from l),
    p as (select doc_id, q, 0 as nth, 'phrase' as kind, '"' || replace(q, '"', '""') || '"' as match_query, '' as terms from t
          union all select doc_id, q, 1, 'token', array_to_string(list_transform(w, lambda x: '"' || replace(x, '"', '""') || '"'), ' OR '), '' from t where len(f) >= 2 and len(w) > 0
          union all select doc_id, q, 2, 'profile', '', array_to_string(terms, '|') from t where len(terms) > 0)
    select doc_id, (row_number() over (partition by doc_id order by nth) - 1)::int as no, kind, match_query, terms from p
"""


@query(PLANS_SQL)
def search_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts that a search makes for the first words of each document, three at most."""

    def run(batches):
        for batch in batches:
            rows = [(i, no, kind, match, "|".join(terms)) for i, q in zip(batch["doc_id"], batch["query"]) for no, (kind, match, terms) in enumerate(search.plan_attempts(search.Options(q).clamped()))]
            yield pd.DataFrame(rows, columns=["doc_id", "no", "kind", "match_query", "terms"]).astype({"doc_id": "int64", "no": "int32"})

    words = F.slice(F.regexp_extract_all(_text("text"), F.lit(r"[^ \t\n\r\x0b\f]+"), F.lit(0)), 1, 3)
    queries = A.read(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("query")).filter("query <> ''")
    return queries.mapInPandas(run, "doc_id long, no int, kind string, match_query string, terms string")


#: What case folding and dropping marks must undo: a mark on a letter, a capital with a dot, a long s, a Kelvin sign.
MARKED = (("a", "a\u0301"), ("e", "E\u0323\u0306"), ("i", "\u0130"), ("s", "\u017f"), ("k", "\u212a"), ("o", "\u00d3"))


@query(f"select doc_id, len(k)::bigint as tokens, md5(array_to_string(k, ' ')) as digest from (select doc_id, {tokens_sql('text')} as k from documents)")
def marked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written with combining marks and other forms of letters have the tokens of the plain ones."""
    text = F.lower(_text("text"))
    for plain, odd in MARKED:
        text = F.replace(text, F.lit(plain), F.lit(odd))
    k = A.read(spark, sf_dir, "documents").select("doc_id", X.index_tokens(text).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("tokens"), F.md5(F.array_join("k", " ").cast("binary")).alias("digest"))


@query(
    """
    with l as (select doc_id, bool_or(coalesce(quality = 1, false)) as q, bool_or(coalesce(toxic = 1, false)) as t from labels where doc_id is not null group by doc_id)
    select doc_id::varchar as target_id, q and doc_id % 3 <> 0 as canonical, t and doc_id % 3 <> 0 as stale from l where q or t
    """
)
def feedback_flags_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as events of a stream; those of every third document are deleted again, and their flags go."""
    folder = f"{shared_dir(spark)}/flags-{uuid.uuid4().hex}"
    said = A.read(spark, sf_dir, "labels").filter("doc_id is not null")
    kinds = F.filter(F.array(F.when(F.col("quality") == 1, "document_canonical"), F.when(F.col("toxic") == 1, "document_stale")), lambda k: k.isNotNull())
    said = said.select("doc_id", F.explode(kinds).alias("feedback_kind"))
    events = said.select(F.concat_ws("-", "doc_id", "feedback_kind").alias("id"), F.lit("document").alias("target_kind"), F.col("doc_id").cast("string").alias("target_id"), "feedback_kind", F.lit(1).alias("seq"), F.lit(False).alias("deleted"))
    events.write.parquet(f"{folder}/in")
    events.filter(F.col("target_id").cast("long") % 3 == 0).withColumns({"seq": F.lit(2), "deleted": F.lit(True)}).write.mode("append").parquet(f"{folder}/in")
    follow_flags(spark.readStream.schema(EVENTS).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return live_flags(spark.read.parquet(f"{folder}/out")).select("target_id", "canonical", "stale")


@query(
    f"""
    with {TOKENS}, x as (with {bm25_sql([PHRASE.split()])} select * from bm),
    a as (select section_id, row_number() over (order by canonical desc, rank, section_id) as place, greatest(rank, 0.1) as weight from x join t using (section_id) where not stale qualify place <= 8),
    b as (select *, greatest(floor(3000.0::double * weight / sum(weight) over ())::bigint, 200) as share from a),
    e as (select *, greatest(sum(share) over () - 3000, 0) as excess, coalesce(sum(share - 200) over (order by place desc rows between unbounded preceding and 1 preceding), 0) as after from b),
    f as (select place, section_id, share - least(greatest(excess - after, 0), share - 200) as budget, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as content from e join documents on doc_id::varchar = section_id)
    select place::int as place, section_id, substr(content, 1, list_max(list_filter(range(0, least(length(content), budget::bigint) + 1), lambda n: strlen(substr(content, 1, n)) <= budget))) as content from f
    """
)
def context_pack_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a pack, each cut to its budget of bytes within a character's bounds."""
    o = search.Options(PHRASE, limit=8, max_searches=1, max_sections_per_document=5)
    out = search.search(o, _index(spark, sf_dir), A.document_sections(spark, sf_dir), A.documents(spark, sf_dir), A.no_profiles(spark), A.feedback(spark, sf_dir))
    return context.pack(out.hits, context.Request(task=PHRASE, max_chars=3000)).select("place", "section_id", "content")


# The store -----------------------------------------------------------------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """A store with the talks as documents of five sources, and a node for each."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    docs, secs = A.talks(spark, sf_dir), A.talk_sections(spark, sf_dir)
    blank = {c: F.lit("").cast("string") for c in ("version", "content_hash", "metadata_json", "acl_json")} | {"page_anchors": F.array().cast("array<string>"), "indexed_at": F.lit(None).cast("timestamp")}
    none = {"content_hash": F.lit(""), "anchors": F.array().cast("array<string>"), "links": F.array().cast("array<struct<href:string,text:string>>")}
    src = docs.select(F.col("source_id").alias("id")).distinct().withColumns({c: F.lit(v) for c, v in (("kind", "local"), ("name", "n"), ("dsn", "/d"), ("config_json", "{}"), ("product_hint", ""), ("module_hint", ""), ("sync_schedule", ""))})
    nodes = graph.node_rows(docs, graph.document_node_id("id"), "Document", F.col("title"), {"document_id": F.col("id"), "source_id": F.col("source_id")})
    times = {c: F.current_timestamp() for c in ("created_at", "updated_at")}
    profile = docs.select(F.col("id").alias("document_id"), F.lit("").alias("desc"), F.lit("{}").alias("retrieval_profile_json"), F.lit("").alias("generated_from_hash"))
    store.commit({"sources": src.withColumns(times), "documents": docs.withColumns(blank), "sections": secs.withColumns(none), "nodes": nodes, "profiles": profile}, store.snapshot())
    return store


@query("select case conv_id % 5 when 1 then 'renamed' else 'n' end as name, 'talks' || (conv_id % 5) as id, count(distinct conv_id) as documents, count(*) as sections, count(distinct conv_id) as nodes from conversations where conv_id % 5 <> 3 group by all")
def store_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source is renamed, another is deleted with all that hangs on it."""
    store = _store(spark, sf_dir)
    store.update_source({"id": "talks1", "name": "renamed"})
    store.delete_source("talks3")
    counts = graph.artifact_counts(store.table("documents"), store.table("sections"), store.table("nodes"), store.table("edges")).select(F.col("source_id").alias("id"), "documents", "sections", "nodes")
    return store.sources().select("id", "name").join(counts, "id")


@query(
    """
    with n as (select count(distinct conv_id) as n from conversations where conv_id % 5 = 1)
    select status, last_error, seq, case when status = 'completed' then n end as documents from n, (values ('failed', 'the process ended while this job was running', 1), ('completed', '', 2), ('failed', 'no such folder', 3)) t(status, last_error, seq)
    """
)
def store_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interrupted job, a completed one that tells of its source's documents, a failed one; a fourth is deleted."""
    store = _store(spark, sf_dir)
    store.start_job("talks1")
    store.fail_interrupted()
    store.end_job(store.start_job("talks1")["id"], {"documents": store.table("documents").filter("source_id = 'talks1'").count()})
    store.end_job(store.start_job("talks1")["id"], error="no such folder")
    store.delete_job("talks1", store.start_job("talks1")["id"])
    told = F.get_json_object("payload_json", "$.documents").cast("long")
    return store.jobs("talks1").select("status", "last_error", F.col("seq").cast("int").alias("seq"), told.alias("documents"))


@query("select conv_id::varchar as document_id, case when conv_id % 7 = 0 then 'about ' || conv_id else '' end as \"desc\" from (select distinct conv_id from conversations) where conv_id % 5 = 2 and conv_id < 60")
def store_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions are put one by one, each a small change."""
    store = _store(spark, sf_dir)
    mine = store.table("documents").filter("source_id = 'talks2' and cast(id as long) < 60").select("id")
    for r in mine.filter("cast(id as long) % 7 = 0").collect():  # two at most
        store.put_profile(r["id"], f"about {r['id']}")
    return store.table("profiles").join(mine.withColumnRenamed("id", "document_id"), "document_id", "left_semi").select("document_id", "desc")


@query(f"select {stable_sql('node', chr(39) + 'document' + chr(39), 'a::varchar')} as src_id, {stable_sql('node', chr(39) + 'document' + chr(39), 'b::varchar')} as dst_id, kind, 'manual' as provenance from (select min(conv_id) as a, max(conv_id) as b, unnest(['owned_by', 'merged_into']) as kind from conversations)")
def store_feedback_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An added relationship and a merge put edges; a deleted event leaves its edge."""
    store = _store(spark, sf_dir)
    ends = store.table("documents").agg(F.min(F.col("id").cast("long")).cast("string").alias("a"), F.max(F.col("id").cast("long")).cast("string").alias("b"))
    r = ends.select(graph.document_node_id("a").alias("a"), graph.document_node_id("b").alias("b")).first()
    event = store.add_feedback({"feedback_kind": "relationship_add", "target_id": r["a"], "payload_json": json.dumps({"src_id": r["a"], "dst_id": r["b"], "kind": "owned_by"})})
    store.add_feedback({"feedback_kind": "node_merge", "target_id": r["a"], "payload_json": json.dumps({"merged_into": r["b"]})})
    store.delete_feedback(event["id"])
    return store.table("edges").select("src_id", "dst_id", "kind", "provenance")
