import random
import sqlite3
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeleaf.functions import text as X
from lakeleaf.functions.ids import canonical, canonical_of, stable_id, stable_id_of


def test_ids(spark):
    row = spark.createDataFrame([("src", "a/b.md")], "s string, p string").select(stable_id("doc", "s", "p").alias("id"), canonical(F.lit("  A\t b "), F.lit("C")).alias("c")).first()
    assert row["id"] == stable_id_of("doc", "src", "a/b.md") and len(row["id"]) == 28
    assert row["c"] == canonical_of("  A\t b ", "C") == "a b c"


WORDS = ["Élève x-y_z, it's 权限b 12½", "ß Æ naïve/Ångström", "", "A.B", "ﬁ Ⅷ"]


def test_tokens_agree_with_driver(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "t string").select("t", X.index_tokens(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in rows] == [X.index_tokens_of(r["t"]) for r in rows]
    assert rows[0]["k"] == ["eleve", "x", "y", "z", "it", "s", "权限b", "12½"]


def test_profile_tokens_and_refs(spark):
    text = "GET /auth/permissions 返回 401, 403 error_code. a (b/c) POST x 权限接口"
    row = spark.createDataFrame([(text,)], "t string").withColumn("k0", X.profile_tokens(F.col("t"))).select(X.profile_tokens(F.col("t")).alias("k"), X.api_refs(F.col("k0")).alias("r"), X.han_ngrams(F.col("t"), 1, 4).alias("h")).first()
    assert row["k"] == ["get", "/auth/permissions", "返回", "401", "403", "error_code", "b/c", "post", "权限接口"]
    assert row["r"] == ["GET /auth/permissions", "/auth/permissions", "401", "403", "error_code"]
    assert row["h"] == X.han_ngrams_of(text, 1, 4) and "错误" not in row["h"] and "权限接口" in row["h"]


def test_like(spark):
    row = spark.createDataFrame([("ÄB_c 50%",)], "t string").select(X.contains_ascii_fold(F.col("t"), "b_C").alias("a"), X.contains_ascii_fold(F.col("t"), "äb").alias("b"), X.like_ascii_fold(F.col("t"), "B%5").alias("c"), X.contains_ascii_fold(F.col("t"), "b%5").alias("d")).first()
    assert tuple(row) == (True, False, True, False)


def test_truncation():
    assert X.truncate_paragraphs("a\n\nb", 10) == "a\n\nb"
    assert X.truncate_paragraphs("one\n\n two \n\nthree", 8) == "one\n\ntwo"
    assert X.truncate_paragraphs("é" * 10, 5) == "éé" and X.truncate_paragraphs("abc", 0) == "abc"


@settings(max_examples=200, deadline=None)
@given(st.text(), st.integers(1, 50))
def test_cut_bytes_is_a_prefix(text, most):
    text = text.encode(errors="ignore").decode()
    cut = X.cut_bytes(text, most)
    assert text.startswith(cut) and len(cut.encode()) <= most


def test_snippets():
    words = " ".join(f"w{i}" for i in range(60))
    out = X.window_snippet(words, [["w30"]])
    assert "<mark>w30</mark>" in out and out.startswith("...w") and out.endswith("...") and len(out.split()) == 16
    assert X.window_snippet(words, [["none"]]) == " ".join(f"w{i}" for i in range(16)) + "..."
    assert X.window_snippet("Élève a", [["eleve"]]) == "<mark>Élève</mark> a"
    assert X.term_snippet("x" * 100 + "Term" + "y" * 100, "term") == "..." + "x" * 70 + "<mark>Term</mark>" + "y" * 90 + "..."


@pytest.mark.parametrize(("a", "b"), [("", []), ("一二三", ["一", "二", "三", "一二", "二三", "一二三"])])
def test_han(a, b):
    assert X.han_ngrams_of(a, 1, 4) == b


ODD_WORDS = "cafe\u0301s nai\u0308ve İstanbul i\u0307x ΟΔΟΣ οδος straße ẞ ǅ a\u0345b \u0301a ſ K Ⅷ ①② x\u200dy ế ǖ ȱ 한국 \ue000q ab_c क्षि ｆＵ Ქ Ԩ".split()


def fts(*columns):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5({', '.join(columns)})")
    return con


def test_tokens_are_those_of_fts5(spark):
    con = fts("a")
    con.execute("create virtual table v using fts5vocab(t, instance)")
    rng = random.Random(4)
    texts = [" ".join(ODD_WORDS), *("".join(rng.choice([*ODD_WORDS, " ", "-", ". ", "\u0301", "Á"]) for _ in range(rng.randrange(12))) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.index_tokens(F.col("t")).alias("k")).collect()
    for r in rows:
        con.execute("delete from t")
        con.execute("insert into t values (?)", (r["t"],))
        want = [x for (x,) in con.execute("select term from v order by offset")]
        assert (X.index_tokens_of(r["t"]), r["k"]) == (want, want), r["t"]


def test_snippets_are_those_of_fts5():
    con, rng, seen = fts("title", "content"), random.Random(9), 0
    known = "alpha beta gamma delta eps café cafe\u0301s οδος ΟΔΟΣ zeta the of x y".split()
    while seen < 600:
        text = "".join(rng.choice(known) + rng.choice([" ", " ", ". ", ": ", ".\n", ", ", "-", ".", " :\t"]) for _ in range(rng.choice([3, 10, 18, 40, 90])))
        phrases = [[rng.choice(known) for _ in range(rng.choice([1, 1, 2, 3]))] for _ in range(rng.choice([1, 1, 2, 3]))]
        if rng.random() < 0.4:  # phrases that occur, longer than the window too
            tokens, at = X.index_tokens_of(text), rng.randrange(3)
            phrases[0] = tokens[at : at + rng.choice([2, 3, 5, 18])] or phrases[0]
        con.execute("delete from t")
        con.execute("insert into t values (?, ?)", ("alpha", text))
        match = " OR ".join('"' + " ".join(p) + '"' for p in phrases)
        row = con.execute("select snippet(t, 1, '<mark>', '</mark>', '...', 16) from t where t match ?", (match,)).fetchone()
        if row:
            seen += 1
            assert X.window_snippet(text, [X.index_tokens_of(" ".join(p)) for p in phrases]) == row[0], (match, text)


def test_snippets_of_long_texts_take_no_square():
    began = time.time()
    X.window_snippet("a b. c " * 60000, [["b"], ["c", "a"]])
    X.window_snippet("a b. c " * 60000 + "zz", [["zz"]])
    assert time.time() - began < 5
