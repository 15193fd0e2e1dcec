"""Operator 11."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from lakeleaf.llm import fim, queries

SF = "/root/testdata/sf0.001"


def brute(doc_id, text, settings=fim.Settings()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digits = hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= settings.rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < settings.spm else "psm"
    return n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "<P>", "x<S\n>y", "<<M>>", "<P<S>", "<\nP>", "é<P", "€\n😀\n<", "\r\n\x0b\x85 z\n", "<S", ">\n<", "P>\nS>\nM>", "\x00\n\x00", "😀" * 70000 + "\n" + "é", "a" * 65535 + "<P>", "a" * 65534 + "<\nP>", "b" * 65536 + "\n"]


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_automaton(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(5)
    texts = [t or "" for t in ODD if not t or len(t) < 1000 or block > 4] + ["".join(rng.choice("ab<<PSM>\n\né€😀") for _ in range(rng.randrange(40))) for _ in range(1500)]
    for i, t in enumerate(texts):
        digits = hashlib.sha256(f"7:{i}".encode()).hexdigest()
        got = fim.arranged(t.encode(), tuple(int(digits[8 * j : 8 * j + 8], 16) for j in range(4)), fim.Settings())
        assert (*got[:-1], got[-1].decode()) == brute(i, t), (i, t[:50])


def test_table_counts_characters():
    assert len(fim.TABLE) == 7 * 256
    data = np.frombuffer("a€\n😀é\n".encode(), dtype=np.uint8)
    seen = fim.first_pass(data)
    assert (seen.n, int(seen.characters.sum()), seen.open_unit, seen.sentinels) == (2, 6, False, 0)
    assert [fim.cut(data, seen, k) for k in range(3)] == [(0, 0), (5, 3), (12, 6)]


@pytest.mark.parametrize("settings", [fim.Settings(), fim.Settings(seed=3, rate=50, spm=20)])
def test_spark_rows(spark, monkeypatch, settings):
    monkeypatch.setattr(fim, "SENT", 50)
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(0, "", "clash", 1), (4, "a", "x", 2), (None, "p\nq\nr", None, None), (77, "one\ntwo\nthree\nfour", "", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    got = fim.fill_in_middle(df, settings)
    key = lambda r: str(r)[:300]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i, *brute(i, t, settings)) for i, t, _, _ in rows), key=key)
    back = got.select("doc_id", fim.restored(got["output"], got["form"]).alias("t")).collect()
    assert sorted((str(r["doc_id"]), r["t"]) for r in back) == sorted((str(i), t or "") for i, t, _, _ in rows)
    assert fim.fill_in_middle_digests(df.limit(0)).count() == 0


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.op11_fill_in_middle(spark, SF), con.sql(queries.SQL["op11_fill_in_middle"])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(str, want.select(*columns).fetchall())) and len(rows) == 200
    assert all(r["output_sha256"] != r["restored_sha256"] or r["form"] == "plain" for r in got.collect())
