import io
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from lakeleaf.operators import context, graph, profiles, search
from lakeleaf.operators.feedback import check_event
from lakeleaf.operators.segments import Segments
from lakeleaf.plans import store as store_module
from lakeleaf.plans.store import SCHEMAS, Conflict, NotFound, Store, SyncInProgress
from lakeleaf.plans.sync import payload, sync_source
from lakeleaf.service import cli, config
from lakeleaf.service.routes import Api
from lakeleaf.service.tools import Tools

DOCS = [("doc-1", "s1", "rules.md", "Rules"), ("doc-2", "s1", "perm.md", "权限接口")]
SECTIONS = [
    ("sec-1", "doc-1", 0, "Benefit Rules", "Rules > Benefit Rules", "membership entitlement configuration"),
    ("sec-2", "doc-1", 1, "Checkout Rules", "Rules > Checkout Rules", "payment routing configuration"),
    ("sec-3", "doc-2", 0, "错误响应", "权限接口 > 错误响应", "权限接口的几种错误响应包括 401 和 403。GET /auth/permissions error_code"),
]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(*d, "", "h-" + d[0]) for d in DOCS], "id string, source_id string, external_id string, title string, url string, content_hash string")
    secs = spark.createDataFrame(SECTIONS, "id string, document_id string, ordinal int, title string, heading_path string, content string")
    return docs, secs, profiles.profile_rows(docs, secs), spark.createDataFrame([], SCHEMAS["feedback"])


def built(docs, secs, prof, root=None):
    none = docs.sparkSession.createDataFrame([], SCHEMAS["feedback"])
    return Segments.create(secs, search.live(docs, prof, none), root or tempfile.mkdtemp(prefix="lakeleaf-index-"))


def find(tables, **options):
    docs, secs, prof, feedback = tables
    return search.search(search.Options(**options), built(docs, secs, prof), secs, docs, prof, feedback)


def test_phrase_search_marks_its_hit(tables):
    out = find(tables, query="membership", max_searches=1)
    (hit,) = out.hits.collect()
    assert hit["section_id"] == "sec-1" and "<mark>membership</mark>" in hit["snippet"] and hit["rank"] < 0
    assert find(tables, query="  ").hits is None and find(tables, query="...", max_searches=1).hits.collect() == []


def test_han_search_tries_substrings(tables):
    out = find(tables, query="错误响应", max_searches=5)
    assert [a["kind"] for a in out.attempts] == ["phrase", "ngram", "profile"]
    (hit,) = out.hits.filter("section_id = 'sec-3'").collect()
    assert "ngram" in hit["match"]["search_attempts"] and "错误响应" in hit["profile"]["top_tags"]


def test_caps_and_details(tables):
    assert find(tables, query="configuration", max_sections_per_document=1).hits.count() == 1
    hits = find(tables, query="configuration", detail="summary").hits.collect()
    assert [h["content"] for h in hits] == ["", ""] and hits[0]["match"] is None
    full = find(tables, query="configuration", profile_detail="full", max_chars=10).hits.first()
    assert len(full["content"]) <= 10 and len(full["retrieval_profile"]["section_distribution"]) == 2
    o = search.Options("x", 999, 9, 0, "odd", -1).clamped()
    assert (o.limit, o.max_searches, o.max_sections_per_document, o.profile_detail, o.max_chars) == (20, 5, 2, "compact", 0)


def test_canonical_first_and_stale_hidden(spark, tables):
    docs, secs, prof, _ = tables
    twin = secs.unionByName(spark.createDataFrame([("sec-9", "doc-2", 1, "T", "T", "payment routing configuration")], secs.schema))
    events = spark.createDataFrame([("f1", 1, "document", "doc-2", "document_canonical", "{}", "", None), ("f2", 2, "document", "doc-1", "document_stale", "{}", "", None)], SCHEMAS["feedback"])
    index = built(docs, twin, prof)
    out = search.search(search.Options("payment routing", max_searches=1), index, twin, docs, prof, events.filter("id = 'f1'")).hits.orderBy("place").collect()
    assert [h["section_id"] for h in out] == ["sec-9", "sec-2"] and out[0]["canonical"]
    assert [h["section_id"] for h in search.search(search.Options("payment routing", max_searches=1), index, twin, docs, prof, events).hits.collect()] == ["sec-9"]


def test_index_round_trip(spark, tables, tmp_path):
    docs, secs, prof, _ = tables
    index = built(docs, secs, prof, str(tmp_path))
    index = Segments(spark, str(tmp_path), index.names, index.sizes)
    assert {s for _, _, s, _ in index.match([["configuration"]], 9)} == {"sec-1", "sec-2"}
    assert index.match([["payment", "routing"]], 9)[0][2:] == ("sec-2", "doc-1") and index.match([[]], 9) == [] and index.match([["none"], ["no", "ne"]], 9) == []


def test_profile_terms(tables):
    docs, secs, _, _ = tables
    row = profiles.build_profiles(docs, secs).filter("document_id = 'doc-2'").first()
    terms = [t["term"] for t in row["top_terms"]]
    assert {"权限", "接口", "错误", "响应", "错误响应"} <= set(terms)
    assert {"/auth/permissions", "401", "403", "GET /auth/permissions"} <= set(row["api_refs"]) and row["aliases"][:2] == ["权限接口", "perm.md"]
    assert row["stats"]["section_count"] == 1 and len(row["section_distribution"][0]["terms"]) <= 8
    scores = [(-t["score"], t["term"]) for t in row["top_terms"]]
    assert scores == sorted(scores)


def test_profiles_are_refreshed_by_hash(spark, tables):
    docs, secs, prof, _ = tables
    kept = spark.createDataFrame([r.asDict() | {"desc": "mine"} for r in prof.collect()], prof.schema)
    changed = docs.withColumn("content_hash", F.when(F.col("id") == "doc-1", "new").otherwise(F.col("content_hash")))
    out = {r["document_id"]: r for r in profiles.refresh_profiles(kept, changed, secs).collect()}
    assert out["doc-1"]["generated_from_hash"] == "new" and out["doc-1"]["desc"] == "mine" and len(out) == 2


def test_budgets(spark):
    ranks = [-1.0, -0.5, 1000.0]
    hits = spark.createDataFrame([(i + 1, r) for i, r in enumerate(ranks)], "place int, rank double")
    got = [r["budget"] for r in context.budgets(hits, 1000).orderBy("place").collect()]
    assert got == [200, 200, 600]
    assert [r["budget"] for r in context.budgets(hits.withColumn("rank", F.lit(-1.0)), 300).orderBy("place").collect()] == [200, 200, 200]
    with pytest.raises(ValueError):
        context.Request().clamped()


def graph_tables(spark, extra=()):
    nodes = spark.createDataFrame([(i, k, n, n.lower(), {}, 1.0) for i, k, n in (("product", "Product", "P"), ("api", "API", "A"), ("module", "Module", "M"), ("section", "DocSection", "S"))], SCHEMAS["nodes"])
    rows = [("e1", "product", "api", "exposes_api"), ("e2", "product", "section", "contains"), ("e3", "api", "module", "describes"), ("e4", "module", "product", "depends_on"), *extra]
    edges = spark.createDataFrame([(*r, 1.0, "rule", None, "{}") for r in rows], SCHEMAS["edges"])
    return nodes, edges, spark.createDataFrame([], SCHEMAS["feedback"])


def test_impact(spark):
    t = graph_tables(spark)
    assert graph.impact(*t, "product", depth=1).count() == 2
    assert graph.impact(*t, "product", depth=1, kinds=["contains"]).count() == 1
    assert graph.impact(*t, "product", direction="in", depth=1).count() == 1
    paths = graph.impact(*t, "product", depth=5).collect()
    assert all(len(set(p["path_nodes"])) == len(p["path_nodes"]) == p["hops"] + 1 for p in paths)
    assert max(p["hops"] for p in paths) == 2 and graph.impact(*t, "none").count() == 0
    for run in (graph.related, graph.impact):
        for bad in (("product", "sideways"), (" ", "out")):
            with pytest.raises(ValueError):
                run(*t, *bad)


def test_hot_link_targets_are_split(spark):
    """Half of all links go to one section, a tenth to none that could be named; no task of the join gets many of them."""
    keys = ["index#" if i % 2 else None if i % 10 == 0 else f"p{i % 4001}#" for i in range(20000)]
    links = spark.createDataFrame([(f"d{i}", f"s{i}", f"h{i}", "t", [k] if k else []) for i, k in enumerate(keys)], "document_id string, section_id string, href string, text string, candidates array<string>").repartition(8)
    targets = spark.createDataFrame([("index#", "start"), *((f"p{i}#", f"t{i}") for i in range(0, 4001, 2))], "key string, section_id string")
    rows = links.select("section_id", F.explode_outer("candidates").alias("key"))
    assert graph.heavy_keys(rows) == ["index#"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [n for (n,) in graph.join_targets(rows, targets).groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 20000 and max(tasks) <= 2 * sorted(tasks)[len(tasks) // 2]
    edges, broken = graph.resolve_links(links, targets)
    known = {k: t for k, t in targets.collect()}
    assert edges.count() == sum(k in known for k in keys) and broken.count() == sum(k not in known for k in keys)


def test_written_adjacency_changes_nothing(spark, tmp_path):
    nodes, edges, none = graph_tables(spark, [("loop", "api", "api", "contains")])
    wrong = spark.createDataFrame([("f", 1, "edge", "e3", "relationship_wrong", "{}", "", None)], SCHEMAS["feedback"])
    written = graph.write_adjacency(nodes, edges, str(tmp_path))
    for events in (none, wrong):
        for way in ("both", "out", "in"):
            a, b = (graph.related(nodes, edges, events, " api ", way, "", 3, w).collect() for w in (None, written))
            assert a == b and a
            a, b = (graph.impact(nodes, edges, events, "product", way, 3, None, 5, w).collect() for w in (None, written))
            assert a == b and len(a) <= 5
            a, b = (graph.impact(nodes, edges, events, "product", way, 2, ["contains", "depends_on"], 50, w).collect() for w in (None, written))
            assert a == b


def test_related_and_wrong_edges(spark):
    nodes, edges, none = graph_tables(spark, [("loop", "api", "api", "contains")])
    rows = graph.related(nodes, edges, none, "api").collect()
    assert [(r["edge_id"], r["direction"]) for r in rows] == [("loop", "out"), ("e3", "out"), ("loop", "out"), ("e1", "in")]
    wrong = spark.createDataFrame([("f", 1, "edge", "e3", "relationship_wrong", "{}", "", None)], SCHEMAS["feedback"])
    assert [r["edge_id"] for r in graph.related(nodes, edges, wrong, "api", "out").collect()] == ["loop"]


def test_upserts_are_idempotent(spark):
    nodes, edges, _ = graph_tables(spark)
    new = graph.checked_nodes(spark.createDataFrame([(" api ", "API", "B", "", {}, 0.0), ("", "x", "y", "", {}, 1.0)], SCHEMAS["nodes"]))
    once = graph.upsert(nodes, new)
    twice = graph.upsert(once, new)
    assert once.count() == twice.count() == 4 and twice.filter("id = 'api'").first()["name"] == "B" and twice.filter("id = 'api'").first()["confidence"] == 1.0
    bad = spark.createDataFrame([("e9", "api", "ghost", "x", 0.0, "", "", "{}")], SCHEMAS["edges"])
    assert graph.checked_edges(bad, nodes).count() == 0


@pytest.mark.parametrize(
    "event",
    [{"feedback_kind": "odd", "target_id": "x"}, {"feedback_kind": "document_stale", "target_kind": "node", "target_id": "x"}, {"feedback_kind": "document_stale"},
     {"feedback_kind": "node_merge", "target_id": "a", "payload_json": '{"merged_into": "a"}'}, {"feedback_kind": "relationship_add", "target_id": "a", "payload_json": "{}"}, {"feedback_kind": "document_stale", "target_id": "x", "payload_json": "{"}],
)
def test_bad_events(event):
    with pytest.raises(ValueError):
        check_event(event)


@pytest.fixture
def site(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "index.html").write_text('<title>Home</title><h1>Home</h1><p>See <a href="details.html#quota">quota</a>, member benefits GET /member/benefits</p>')
    (docs / "details.html").write_text('<title>Details</title><h2 id="quota">Quota</h2><p>limits</p>')
    (docs / "note.txt").write_text("plain note")
    return docs


def test_source_life(spark, tmp_path, site):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.status()
    for bad in ({"kind": "odd", "name": "n", "dsn": "d"}, {"kind": "local", "name": "", "dsn": "d"}):
        with pytest.raises(ValueError):
            store.put_source(bad)
    src = store.put_source({"kind": "static", "name": "docs", "dsn": str(site), "product_hint": "Membership", "module_hint": "Benefits"})["id"]
    job = sync_source(store, src)
    assert job["status"] == "completed" and payload(job)["documents"] == 3 and payload(job)["broken_links"] == []
    first = store.status()
    assert sync_source(store, src)["status"] == "completed"
    assert {k: v for k, v in store.status().items() if k != "jobs"} == {k: v for k, v in first.items() if k != "jobs"}
    assert store.table("edges").filter("kind = 'links_to'").count() == 1 and store.table("nodes").filter("kind = 'API'").count() == 1

    (site / "details.html").unlink()
    broken = payload(sync_source(store, src))["broken_links"]
    assert [b["target"] for b in broken] == ["details.html#quota"] and store.status()["documents"] == 2

    api = Api(store, {"mode": "token", "token": "t"})
    key = {"X-Api-Token": "t"}
    assert api.handle("GET", "/api/health")[0] == 200 and api.handle("GET", "/api/status")[0] == 401
    status, found = api.handle("POST", "/api/search", b'{"query": "member benefits"}', key)
    assert status == 200 and found["hits"][0]["document_title"] == "Home"
    assert api.handle("POST", "/api/search", b"{}", key)[0] == 400 and api.handle("GET", "/api/nodes/none", b"", key)[0] == 404
    assert api.handle("GET", f"/api/sources/{src}/artifacts?limit=1", b"", key)[1]["counts"]["documents"] == 2
    updated = api.handle("PUT", f"/api/sources/{src}", b'{"max_pages": "3", "name": "again"}', key)[1]
    assert json.loads(updated["config_json"]) == {"max_pages": "3"} and updated["name"] == "again"
    assert json.loads(api.handle("PUT", f"/api/sources/{src}", b'{"max_pages": ""}', key)[1]["config_json"]) == {}

    doc = store.table("documents").filter("title = 'Home'").first()["id"]
    event = api.handle("POST", "/api/feedback", json.dumps({"feedback_kind": "document_stale", "target_id": doc}).encode(), key)[1]
    assert store.search(search.Options("member benefits", max_searches=1)).hits.count() == 0
    assert api.handle("DELETE", f"/api/feedback/{event['id']}", b"", key)[0] == 200
    assert store.search(search.Options("member benefits", max_searches=1)).hits.count() == 1
    node = graph_node(store, "Home")
    store.add_feedback({"feedback_kind": "relationship_add", "target_id": node, "payload_json": json.dumps({"src_id": node, "dst_id": graph_node(store, "Membership"), "kind": "owned_by"})})
    assert "owned_by" in [r["edge_kind"] for r in store.related(node, "out").collect()]

    tools = Tools(store)
    call = lambda name, **a: tools.respond(json.dumps({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}))
    hit = json.loads(call("product_search", query="member benefits")["result"]["content"][0]["text"])["hits"][0]
    assert hit["content"] == "" and "member" in json.loads(call("doc_get_section", id=hit["section_id"])["result"]["content"][0]["text"])["content"]
    assert call("doc_related", id="")["error"]["code"] == -32602 and tools.respond("{")["error"]["code"] == -32700 and tools.respond('{"id": 1, "method": "x"}')["error"]["code"] == -32601
    assert tools.respond('{"method": "notifications/initialized"}') is None and len(tools.respond('{"id": 1, "method": "tools/list"}')["result"]["tools"]) == 6

    with pytest.raises(SyncInProgress):
        store.start_job(src)
        store.start_job(src)
    assert store.fail_interrupted() == 1 and store.fail_interrupted() == 0
    assert store.jobs(src).first()["status"] == "failed" and "ended" in store.jobs(src).first()["last_error"]
    assert api.handle("POST", "/api/impact", json.dumps({"id": node, "direction": "odd"}).encode(), key)[0] == 400
    assert api.handle("POST", "/api/impact", b'{"id": "none"}', key)[0] == 404
    answer = api.handle("POST", "/api/impact", json.dumps({"id": node}).encode(), key)[1]
    assert answer["start_node"]["id"] == node and answer["paths"]
    assert api.handle("GET", f"/api/nodes/{node}/related?direction=odd", b"", key)[0] == 400
    store.delete_source(src)
    assert store.status()["documents"] == store.status()["nodes"] == store.status()["edges"] == 0 and store.status()["jobs"] == 4
    with pytest.raises(NotFound):
        store.source(src)


def graph_node(store, name):
    return store.table("nodes").filter(F.col("name") == name).first()["id"]


def test_all_broken_links_are_kept(spark, tmp_path):
    docs = tmp_path / "many"
    docs.mkdir()
    (docs / "index.html").write_text("<h1>Links</h1><p>" + "".join(f'<a href="gone{i}.html">g{i}</a> ' for i in range(1100)) + "</p>")
    store = Store(spark, str(tmp_path / "store"))
    src = store.put_source({"kind": "html", "name": "n", "dsn": str(docs)})["id"]
    found = payload(sync_source(store, src))
    assert found["broken_link_count"] == 1100 and len(found["broken_links"]) == 1000
    assert {r["href"] for r in store.broken_links(src).collect()} == {f"gone{i}.html" for i in range(1100)}
    store.delete_source(src)
    assert store.table("broken_links").count() == 0


def test_pages_by_key(spark):
    docs = spark.createDataFrame([(f"d{i:02d}", f"T{i % 4}") for i in range(23)], "id string, title string")
    secs = spark.createDataFrame([(f"s{i}", f"d{i % 7:02d}") for i in range(30)], "id string, document_id string")
    whole = [tuple(r) for r in graph.documents_page(docs, secs, 200).collect()]
    assert len(whole) == 23 and sum(n for *_, n in whole) == 30
    seen, after = [], None
    while page := [tuple(r) for r in graph.documents_page(docs, secs, 5, after=after).collect()]:
        assert page == [tuple(r) for r in graph.documents_page(docs, secs, 5, len(seen)).collect()]
        seen += page
        after = page[-1][1], page[-1][0]
    assert seen == whole
    plan = graph.beyond(docs, ("title", "id"), ("T1", "d01"))._jdf.queryExecution().optimizedPlan().toString()
    assert ">= T1" in plan


def test_writers_don_t_lose_changes(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    ids = [one.put_source({"kind": "local", "name": n, "dsn": "/d"})["id"] for n in "ab"]
    seen = one.snapshot()
    two.start_job(ids[0])
    # Another table was changed meanwhile: both changes hold.
    one.change({"sources": [one.source(ids[0]) | {"name": "c"}]}, seen=seen)
    assert one.source(ids[0])["name"] == "c" and two.jobs(ids[0]).count() == 1
    # The same one was: the second writer is told.
    with pytest.raises(Conflict):
        one.commit({"sources": one.table("sources", seen)}, seen)
    with pytest.raises(Conflict):
        one.change({"feedback": []}, seen=seen, read={"jobs"})
    # Many changes are folded into the table's rows, and old versions go.
    monkeypatch.setattr(store_module, "DELTAS", 3)
    for n in range(8):
        one.put_source({"id": ids[1], "kind": "local", "name": f"n{n}", "dsn": "/d"})
    assert len(one.current()["sources"]) <= 4 and {r["name"] for r in two.sources().collect()} == {"c", "n7"}
    assert one.vacuum(keep=1) > 0 and {r["name"] for r in two.sources().collect()} == {"c", "n7"} and two.jobs(ids[0]).count() == 1


def test_writers_between_reading_and_commit(spark, tmp_path, monkeypatch):
    """A change that another writer makes after a table was read, and before the result is published, isn't lost."""
    one, two = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    node = lambda i: spark.createDataFrame([(i, "API", i, i, {}, 1.0)], SCHEMAS["nodes"])
    edge = lambda i: spark.createDataFrame([(i, "n0", "n0", "contains", 1.0, "rule", None, "{}")], SCHEMAS["edges"])
    event = {"feedback_kind": "document_stale", "target_id": "d"}
    one.put_nodes(node("n0"))
    source = one.put_source({"kind": "local", "name": "a", "dsn": "/d"})["id"]
    kept = Store._publish

    def meanwhile(change):
        def publish(self, number, tables):
            if self is one and change is not None:
                monkeypatch.setattr(Store, "_publish", kept)
                change()
            return kept(self, number, tables)

        monkeypatch.setattr(Store, "_publish", publish)

    for own, other in (
        (lambda: one.put_nodes(node("n1")), lambda: two.put_nodes(node("n2"))), (lambda: one.put_edges(edge("e1")), lambda: two.put_edges(edge("e2"))), (lambda: one.add_feedback(event), lambda: two.add_feedback(event)),
        (lambda: one.update_source({"id": source, "name": "b"}), lambda: two.update_source({"id": source, "dsn": "/e"})), (lambda: one.delete_source(source), lambda: two.put_nodes(node("n3"))),
    ):
        meanwhile(other)
        own()
        if one.sources().count():
            assert (one.source(source)["name"], one.source(source)["dsn"]) in (("a", "/d"), ("b", "/e"))
    assert {r["id"] for r in one.table("nodes").collect()} == {"n0", "n1", "n2", "n3"} and {r["id"] for r in one.table("edges").collect()} == {"e1", "e2"}
    assert sorted(r["seq"] for r in one.table("feedback").collect()) == [1, 2] and one.sources().count() == 0
    monkeypatch.setattr(store_module, "RETRIES", 1)
    meanwhile(lambda: two.put_nodes(node("n4")))
    with pytest.raises(Conflict):
        one.put_nodes(node("n5"))
    meanwhile(lambda: two.add_feedback(event))
    status, answer = Api(one).handle("POST", "/api/feedback", json.dumps(event).encode())
    assert status == 409 and "another writer" in answer["error"]["message"]


def test_kept_adjacency(spark, tmp_path, monkeypatch):
    """Related nodes and paths of the store equal those of its tables, whatever was changed since the adjacency was written."""
    monkeypatch.setattr("lakeleaf.operators.adjacency.BLOCK", 2)
    store = Store(spark, str(tmp_path / "store"))
    nodes, edges, none = graph_tables(spark, [("loop", "api", "api", "contains"), *((f"h{i}", "product", "api", f"k{i % 3}") for i in range(7))])
    store.commit({"nodes": nodes, "edges": edges}, store.snapshot())

    def agrees(turn):
        t = (store.table("nodes"), store.table("edges"), store.table("feedback"))
        for args in (("product", "both", "", 50), ("api", "in", "", 3), ("product", "both", "k1", 50)):
            a, b = ([r.asDict() for r in f.collect()] for f in (store.related(*args), graph.related(*t, *args)))
            assert a == b, (turn, args)
        assert store.impact("product", "both", 3, None, 30).collect() == graph.impact(*t, "product", "both", 3, None, 30).collect(), turn

    agrees(0)
    first = store.current()["adjacency"]
    assert len(first) == 1
    plan = store.related("product")._jdf.queryExecution().toString() + store.adjacency().rows().filter("from_id = 'x' and block = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(from_id), IsNotNull(block), EqualTo(from_id,x), EqualTo(block,0)]" in plan
    store.add_feedback({"feedback_kind": "relationship_add", "target_id": "api", "payload_json": json.dumps({"src_id": "api", "dst_id": "section", "kind": "added"})})
    agrees(1)
    assert store.current()["adjacency"][0] == first[0] and len(store.current()["adjacency"]) == 2
    added = spark.read.parquet(*[f"{store.root}/{n}/rows" for n in store.current()["adjacency"][1:]])
    assert added.count() == 2  # one edge, both ends
    store.add_feedback({"feedback_kind": "relationship_wrong", "target_id": "h1"})
    store.put_nodes(spark.createDataFrame([("api", "API", "Renamed", "renamed", {}, 1.0), ("new", "API", "N", "n", {}, 1.0)], SCHEMAS["nodes"]))
    store.put_edges(spark.createDataFrame([("e9", "new", "product", "contains", 1.0, "rule", None, "{}"), ("h2", "module", "api", "k2", 1.0, "rule", None, "{}")], SCHEMAS["edges"]))
    agrees(2)
    assert store.current()["adjacency"][0] == first[0]
    store.change({"nodes": [{"id": "section", "kind": "DocSection", "name": "Other", "canonical_name": "other", "metadata": {}, "confidence": 1.0}]})
    monkeypatch.setattr("lakeleaf.operators.adjacency.CHANGES", 1)
    store.change({"edges": [{"id": "e1", "src_id": "section", "dst_id": "new", "kind": "x", "confidence": 1.0, "provenance": "rule", "metadata_json": "{}"}]})
    agrees(4)
    assert len(store.current()["adjacency"]) == 1


def test_failed_sync_leaves_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    src = store.put_source({"kind": "local", "name": "x", "dsn": "https://x/"})["id"]
    job = sync_source(store, src)
    assert job["status"] == "failed" and "unsupported" in job["last_error"] and store.status()["documents"] == 0
    store.delete_job(src, job["id"])
    assert store.jobs(src).count() == 0


def test_command_line(spark, tmp_path, site):
    path = tmp_path / "c.yaml"
    path.write_text(f"storage:\n  dsn: {tmp_path}/store  # here\n")

    def run(*argv):
        out = io.StringIO()
        code = cli.main(["--config", str(path), *argv], spark, out)
        return code, json.loads(out.getvalue()) if code == 0 else None

    source = run("source", "add", "--kind", "static", "--name", "docs", "--dsn", str(site), "--include", "**/*.txt")[1]
    assert json.loads(source["config_json"]) == {"include": "**/*.txt"}
    assert run("source", "sync", source["id"])[1]["status"] == "completed"
    assert run("status")[1]["documents"] == 1 and run("search", "plain", "note")[1]["hits"][0]["content"] == "plain note"
    assert run("context", "plain note")[1]["sections"][0]["content"] == "plain note"
    assert run("node", "get", "nothing")[0] == 1 and run("version")[0] == 0


@pytest.mark.parametrize("text", ["port: 1\n", "server:\n  port: x\n", "server:\n  odd: 1\n", "odd:\n  a: 1\n", "auth:\n  mode: token\n", "auth:\n  mode: odd\n", "nonsense\n", "storage:\n  dsn: ''\n"])
def test_bad_config(tmp_path, text):
    path = tmp_path / "c.yaml"
    path.write_text(text)
    with pytest.raises(ValueError):
        config.load(str(path))


def test_streamed_sections(spark, tmp_path):
    from lakeleaf.streaming.incremental import follow_sections

    store = Store(spark, str(tmp_path / "store"))
    folder = str(tmp_path / "in")
    for n, text in enumerate(("old", "new")):
        spark.createDataFrame([("s1", "d1", 0, "t", "t", text, "", [], [])], SCHEMAS["sections"]).write.mode("append").parquet(folder)
        follow_sections(store, folder, str(tmp_path / "cp")).awaitTermination()
        assert [r["content"] for r in store.table("sections").collect()] == [text], n
        assert [h["section_id"] for h in store.search(search.Options(text, max_searches=1)).hits.collect()] == ["s1"]
        assert store.status()["documents"] == 1 and store.status()["nodes"] == 2 and store.table("profiles").count() == 1
