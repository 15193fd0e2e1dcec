"""The search index in segments, against full builds and brute force."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeleaf.functions import text as X
from lakeleaf.operators import search, segments
from lakeleaf.operators.segments import Segments
from lakeleaf.plans.store import SCHEMAS

WORDS = "the the the the of of of and alpha beta gamma delta eps zeta café naïve O'Neil 权限接口 错误 token_x α βγ".split()


def corpus(rng, n, first=0):
    """Rows (document id, sections) with a few sections each."""
    return [(f"d{i:04d}", [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 14))) for _ in range(rng.choice([1, 1, 2, 3]))]) for i in range(first, first + n)]


def frames(spark, docs):
    d = spark.createDataFrame([(i, f"Doc {i}", f"about {i} Alpha", '{"aliases":["Q' + i + '"]}') for i, _ in docs], "document_id string, document_title string, desc string, profile_json string")
    s = spark.createDataFrame([(f"{i}-{k}-{abs(hash(t)) % 9973}", i, k, f"T{k}", f"Doc > T{k}", t) for i, ts in docs for k, t in enumerate(ts)], "id string, document_id string, ordinal int, title string, heading_path string, content string")
    return s, d


def brute_ranks(secs, phrases, limit, canonical=(), stale=()):
    from math import log

    texts = {r["id"]: (r["document_id"], [X.index_tokens_of(r[c]) for c in ("title", "heading_path", "content")]) for r in secs.collect()}
    dl = {i: sum(map(len, cols)) for i, (_, cols) in texts.items()}
    mean = sum(dl.values()) / len(dl)
    count = lambda cols, p: sum(c[k : k + len(p)] == p for c in cols for k in range(len(c)))
    score = dict.fromkeys(texts, 0.0)
    hit = set()
    for p in phrases:
        f = {i: count(cols, p) for i, (_, cols) in texts.items()}
        df = sum(n > 0 for n in f.values())
        idf = max(log((len(texts) - df + 0.5) / (df + 0.5)), 1e-6)
        for i, n in f.items():
            if n:
                hit.add(i)
                score[i] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl[i] / mean))
    found = [(texts[i][0] in canonical, round(-score[i], 9), i) for i in hit if texts[i][0] not in stale]
    return sorted(found, key=lambda x: (not x[0], x[1], x[2]))[:limit]


def ranks(index, spark, phrases, limit, canonical=(), stale=()):
    ids = lambda v: spark.createDataFrame([(x,) for x in v], "document_id string")
    got = index.match(phrases, limit, ids(canonical), ids(stale))
    return sorted([(c, round(r, 9), s) for c, r, s, _ in got], key=lambda x: (not x[0], x[1], x[2]))


QUERIES = [[["the"]], [["the"], ["alpha"], ["zeta"]], [["of", "the"]], [["alpha", "beta"], ["cafe"]], [["the"], ["the"], ["of"]], [["none"]], [["o", "neil"], ["naive"]]]


@pytest.mark.parametrize(("read", "few"), [(8, 0), (8, 99), (1 << 16, 99)])
def test_ranks(spark, tmp_path, monkeypatch, read, few):
    monkeypatch.setattr(segments, "FIRST_READ", read)
    monkeypatch.setattr(segments, "FEW_DOCUMENTS", few)
    monkeypatch.setattr(segments, "MORE", 3)
    docs = corpus(random.Random(1), 120)
    secs, d = frames(spark, docs)
    index = Segments.create(secs, d, str(tmp_path))
    for phrases in QUERIES[1:2] + QUERIES[4:5] if few == 0 else QUERIES:
        for canonical, stale in ((((), ()),) if few == 0 else ()) + ((("d0003", "d0007", "d0050"), ("d0003", "d0011")),):
            assert ranks(index, spark, phrases, 5, canonical, stale) == brute_ranks(secs, phrases, 5, canonical, stale), phrases


def test_common_words_are_not_read_whole(spark, tmp_path, monkeypatch):
    """The best rows come from the highest levels; the whole list of a word isn't read."""
    monkeypatch.setattr(segments, "FIRST_READ", 40)
    rng = random.Random(3)
    docs = [(f"d{i:04d}", ["x " * (i % 7 + 1) + "y " * rng.randrange(60)]) for i in range(400)]
    secs, d = frames(spark, docs)
    index = Segments.create(secs, d, str(tmp_path))
    read = []
    kept = Segments._postings
    monkeypatch.setattr(Segments, "_postings", lambda self, wanted, *more: read.append(kept(self, wanted, *more)) or read[-1])
    assert ranks(index, spark, [["x"]], 3) == brute_ranks(secs, [["x"]], 3)
    assert max(f.count() for f in read) < 200


def test_segments_equal_a_full_build(spark, tmp_path):
    rng = random.Random(2)
    docs = dict(corpus(rng, 60))
    index = Segments.create(*frames(spark, docs.items()), str(tmp_path))
    assert index.updated(*frames(spark, docs.items())) is index  # nothing has changed
    for turn in range(4):
        for i in rng.sample(sorted(docs), 4):
            docs[i] = corpus(rng, 1)[0][1]
        docs.pop(rng.choice(sorted(docs)))
        docs |= dict(corpus(rng, 2, 1000 + 10 * turn))
        secs, d = frames(spark, docs.items())
        index = index.updated(secs, d)
        for phrases in QUERIES[1:3]:
            assert ranks(index, spark, phrases, 7) == brute_ranks(secs, phrases, 7), (turn, phrases)
        assert sorted(r["section_id"] for r in index.rows().select("section_id").collect()) == sorted(r["id"] for r in secs.collect())
        check_substrings(spark, index, secs, d)
    assert 1 < len(index.names) < 6  # small ones were merged


def check_substrings(spark, index, secs, d):
    """Against a scan of all texts."""
    feedback = spark.createDataFrame([("f1", 1, "document", "d0005", "document_canonical", "{}", "", None), ("f2", 2, "document", "d0006", "document_stale", "{}", "", None)], SCHEMAS["feedback"])
    documents = d.select(F.col("document_id").alias("id"), F.col("document_title").alias("title"))
    profiles = d.select("document_id", "desc", F.col("profile_json").alias("retrieval_profile_json"))
    of = {r["document_id"]: r for r in d.collect()}
    low = lambda t: t.translate(str.maketrans(X.UPPER, X.LOWER))
    for terms, in_profile in ((["pha be", "O'N", "权限"], False), (["e t", "z", "DOC D00", "nowhere"], False), (["d001", "qd", "alph"], True)):
        rows = []
        for r in secs.collect():
            doc = of[r["document_id"]]
            fields = (doc["desc"], doc["profile_json"]) if in_profile else (doc["document_title"], r["title"], r["heading_path"], r["content"])
            if r["document_id"] != "d0006":
                rows += [(no, r["document_id"] != "d0005", doc["document_title"], r["ordinal"], r["id"]) for no, t in enumerate(terms) if any(low(t) in low(f) for f in fields)]
        want, once = [], set()
        for no in range(len(terms)):
            for x in sorted(x for x in rows if x[0] == no)[:6]:
                if x[4] not in once:
                    once.add(x[4])
                    want.append((x[4], terms[no]))
        got = search.substring_places(index, secs, documents, feedback, profiles, terms, 6, in_profile)
        assert [(p[0], p[4]) for p in got] == want[:6], (terms, got)


def test_false_candidates(spark, tmp_path):
    """Texts with all grams of a term, but not the term, come first in order; more candidates are then verified."""
    docs = [(f"d{i:04d}", ["abcd bcde cdef" if i < 90 else "abcdef"]) for i in range(95)]
    secs, d = frames(spark, docs)
    index = Segments.create(secs, d, str(tmp_path))
    none = spark.createDataFrame([], SCHEMAS["feedback"])
    got = search.substring_places(index, secs, d.select(F.col("document_id").alias("id"), F.col("document_title").alias("title")), none, d, ["abcdef"], 3)
    assert [p[1] for p in got] == ["d0090", "d0091", "d0092"]


def test_changed_documents_touch_their_own_postings(spark, tmp_path):
    rng = random.Random(6)
    docs = dict(corpus(rng, 300))
    index = Segments.create(*frames(spark, docs.items()), str(tmp_path))
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    for i in sorted(docs)[:10]:
        docs[i] = ["entirely new words here"]
    new = index.updated(*frames(spark, docs.items()))
    assert {p: p.stat().st_mtime_ns for p in before} == before and len(new.names) == 2
    added = spark.read.parquet(f"{tmp_path}/{new.names[1]}/postings")
    assert added.select("document_id").distinct().count() == 10 and added.count() < spark.read.parquet(f"{tmp_path}/{new.names[0]}/postings").count() / 10


def test_grams():
    grams = set(segments.grams_of("Ab\0c é").tolist())
    assert len(grams) == 4 and set(segments.asked_grams("AB")) <= grams and set(segments.asked_grams("C É".lower())) <= grams
    assert segments.asked_grams("x") == [] == segments.asked_grams("")
