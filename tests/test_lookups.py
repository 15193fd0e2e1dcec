"""Look-ups of the catalogue in tables that no index or adjacency is kept of."""

import random

import pytest

from lakeleaf.operators import graph
from lakeleaf.operators.adjacency import Adjacency
from lakeleaf.operators.scans import Scan
from lakeleaf.operators.segments import Segments
from lakeleaf.plans import adapters as A
from lakeleaf.plans import catalogue, catalogue_more  # noqa: F401 (it adds to the catalogue)
from tests.test_segments import QUERIES, brute_ranks, check_substrings, corpus, frames, ranks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["related_nodes", "impact_paths"])
def test_a_look_up_writes_no_adjacency(spark, monkeypatch, tmp_path, name):
    nodes, edges = A.star_nodes(spark, SF), A.star_edges(spark, SF)
    said = catalogue._star_feedback(spark, edges)
    kept = Adjacency(spark, str(tmp_path), []).rebuilt(nodes, edges).rows()
    if name == "related_nodes":
        want = graph.related(nodes, edges, said, catalogue._star_id("nation", "5"), limit=100, written=kept).select("node_id", "edge_id", "edge_kind", "direction")
    else:
        want = graph.impact(nodes, edges, said, catalogue._star_id("region", "1"), "out", 3, None, 200, kept).selectExpr("hops", "array_join(path_nodes, '>')", "array_join(path_edges, '>')", "place")
    want = [tuple(r) for r in want.collect()]
    assert want

    def no(*_):
        raise AssertionError("the look-up writes the whole graph")

    monkeypatch.setattr(Adjacency, "_with", no)
    assert [tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()] == want


def test_scans_rank_as_brute_force(spark):
    docs = corpus(random.Random(1), 60)
    secs, d = frames(spark, docs)
    scan = Scan(secs.unionByName(secs.limit(1).selectExpr("'x' as id", "'nobody' as document_id", "ordinal", "title", "heading_path", "content")), d)  # a section without a document
    for phrases in [*QUERIES[1:5], [["none"]], [["the", "the"]]]:
        assert ranks(scan, spark, phrases, 5, ("d0003", "d0007", "d0050"), ("d0003", "d0011")) == brute_ranks(secs, phrases, 5, ("d0003", "d0007", "d0050"), ("d0003", "d0011")), phrases
    assert scan.match([[]], 5) == [] and scan.match([["the"]], 2)[0][0] is False
    check_substrings(spark, scan, secs, d)


def test_empty_tables_have_no_hits(spark):
    secs, d = (f.limit(0) for f in frames(spark, corpus(random.Random(2), 3)))
    flagged = d.selectExpr("document_id", "document_title", "false as canonical")
    assert Scan(secs, d).match([["the"]], 5) == [] == Scan(secs, d).substrings(["the"], 5, flagged) == Scan(secs, d).substrings(["the"], 5, flagged, in_profile=True)


@pytest.mark.parametrize("name", ["search_substring_terms", "search_profile_terms", "search_cascade", "context_pack", "context_pack_texts", "search_phrase_bm25", "search_or_tokens_bm25"])
def test_a_single_search_builds_no_index(spark, monkeypatch, name):
    def no(*_):
        raise AssertionError("the search writes an index of the whole table")

    monkeypatch.setattr(Segments, "_with", no)
    assert catalogue.QUERIES[name](spark, SF).count() > 0
