"""Operator 13."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeleaf.llm import divergence as dv
from lakeleaf.llm import queries

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: [1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept]  # noqa: E731, B023
        shares, whole = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for s in own:
            parts = {"pair": [(x, sum(map(f, shares[s], shares[x]))) for x in own if x != s], "term": [(t, f(p, q)) for t, p, q in zip(kept, shares[s], whole, strict=True) if own[s][t] and p > q]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize(("seats", "per_seat"), [(4, 32), (2, 1)])
def test_brute_force(spark, monkeypatch, seats, per_seat):
    monkeypatch.setattr(dv, "LEAST_SEATS", seats)
    monkeypatch.setattr(dv, "SEAT_GROUPS", per_seat)
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefgéß" for b in ("", "x", "Y", "ÄÖ", "É", "—", "zz")]
    rows = [(" ".join(rng.choice(words[rng.randrange(3) * 9 :]) for _ in range(rng.randrange(12))), rng.choice(["en", "de"]), f"s{min(rng.randrange(9), rng.randrange(9))}") for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "fr", "only"), ("a a a", None, None), ("a", "", ""), ("a", "", ""), ("1 2 3", "", "digits"), ("b_c[d]é{f}G\x7fh", "", ""), ("x" * 3000 + " y", "es", "s1"), ("x" * 3000, "es", "s2"), ("X" * 3000 + "1", "es", "s2")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "text string, lang string, source string, value int, item string").repartition(5)
    got = sorted(tuple(r) for r in dv.divergence(df, top=7).collect())
    assert got == brute(rows, top=7)
    assert {r[4] for r in got if r[0] == "fr"} == set()


def test_edges(spark):
    schema = "text string, lang string, source string"
    assert dv.divergence(spark.createDataFrame([], schema)).count() == 0
    few = [(None, "en", "a"), ("x", "en", "b"), ("x", "en", None)]
    assert sorted(map(tuple, dv.divergence(spark.createDataFrame(few, schema)).collect())) == brute(few) == sorted(("en", s, "pair", t, 0, r) for s, t, r in (("a", "", 1), ("a", "b", 2), ("b", "", 1), ("b", "a", 2), ("", "a", 1), ("", "b", 2)))


def test_parts_and_arithmetic(monkeypatch):
    monkeypatch.setattr(dv, "PART", 5)
    for text in ("", "ab", "abcdefghij k", "ab cd ef gh ij", "abcd efghijk", " abcdefghijklmn op", "abcdefghij" * 3 + " " * 12 + "c", "é" * 9 + " a" * 9, "a" * 30, " " * 30 + "b"):
        assert [t.decode() for part in dv.term_parts(text.encode()) for t in part] == TERM.findall(text)
    for n, whole in ((0, 1), (10**12, 10**13 + 7), (8 * 10**15, 8 * 10**15 + 1), (5, 7)):
        assert int(dv._scaled(n, whole)) == 1 + 10**9 * (n + 1) // whole
    ids, n = np.array([0, 3, 70000]), np.array([1, 2**40, 3])
    assert all((a == b).all() for a, b in zip(dv.unpacked(dv.packed(ids, n)), (ids, n), strict=True))


@pytest.mark.parametrize("seats", [2, 4, 6, 10])
def test_rounds_meet_once(spark, seats):
    met = []
    for turn in range(seats - 1):
        rows = spark.range(seats).select(F.col("id").cast("int").alias("a"), dv.partner(F.col("id"), turn, seats).alias("b")).collect()
        assert all((r["b"], r["a"]) in {(x["a"], x["b"]) for x in rows} and r["a"] != r["b"] for r in rows)
        met += [(r["a"], r["b"]) for r in rows]
    assert len(set(met)) == len(met) == seats * (seats - 1)


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.op13_divergence(spark, SF), con.sql(queries.SQL["op13_divergence"])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(str, want.select(*columns).fetchall()))
    docs = con.sql("select text, lang, source from documents").fetchall()
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(docs)
