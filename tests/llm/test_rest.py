"""Operators 4, 6, 7 and 9, and the pipeline."""

import hashlib
import math
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeleaf.llm import html_text, queries, topk
from lakeleaf.llm.bpe import Codec
from lakeleaf.llm.html_text import extract, main_text
from lakeleaf.llm.mixing import Mixture, mix, take, word_count
from lakeleaf.llm.topk import top_k
from lakeleaf.llm.url_filter import Rule, url_filter
from tests.llm.test_dedup import frame

SF = "/root/testdata/sf0.001"


def brute_top(rows, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(good, key=lambda x: (x[0], [-y for y in x[1]]))}.items():
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 4096])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(220)]
    rows += [(300 + i, [0.5] * 6) for i in range(40)]  # ties
    rows += [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == brute_top(rows, 5)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [-1e7, 0.0]), (3, [1e16, 1e16]), (4, [3e16, 0.0]), (50, [1e17, -1e17])]
    clip = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
    v = {i: [math.floor(256 * x) for x in w] for i, w in rows}
    want = []
    for q in (0, 50):
        best = sorted((-clip(sum(a * b for a, b in zip(v[q], w))), i) for i, w in v.items() if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0, 3).collect())) == want


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (1, [1.0, 1.0])], schema)
    assert sorted(tuple(r) for r in top_k(few, F.col("vec_id") % 50 == 0, 5).collect()) == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, -65536)]
    large = spark.createDataFrame([(0, [3e4, 3e4]), (1, [3e4, -1.0]), (2, [2e4, 1.0])], schema)
    assert [r["vec_id"] for r in top_k(large, F.col("vec_id") % 50 == 0, 1).collect()] == [1]


RULES = queries.RULES
URLS = [
    ("http://a.b.example.net/en/x?q#f", "allow", "example.net/en/"), ("http://example.net/fr/", "block", "net/"), ("https://x.org/fr/1", "allow", "org/fr/"), ("https://x.org/de", "allow", None), ("http://NET", "allow", None),
    ("http://NET/", "block", "net/"), ("http://notexample.com/de/1", "allow", None), ("http://w.EXAMPLE.com/de/1", "block", "example.com/de/"), ("no url", "allow", None), (None, "allow", None), ("", "allow", None),
    ("x://y.net?/z", "allow", None), ("http://a.net\n/x", "allow", None), ("http://u@net:80/", "allow", None), ("://net/", "block", "net/"), ("http://a..net/", "block", "net/"), ("http://x.net./", "allow", None),
]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_url_filter(spark, monkeypatch, broadcast):
    monkeypatch.setattr("lakeleaf.llm.url_filter.BROADCAST_RULES", broadcast)
    rows = [(i, u, "x", "x") for i, (u, _, _) in enumerate(URLS)]
    df = spark.createDataFrame([*rows, rows[0], (None, "http://q.net/", "", "")], "page_id long, url string, rule string, host string")
    got = url_filter(df, RULES).collect()
    assert len(got) == len(rows) + 2 and sum(r["page_id"] == 0 for r in got) == 2
    by_id = {r["page_id"]: r for r in got}
    assert {i: (by_id[i]["verdict"], by_id[i]["rule"]) for i in range(len(URLS))} == {i: (v, r) for i, (_, v, r) in enumerate(URLS)}
    assert (by_id[0]["host"], by_id[0]["path"]) == ("a.b.example.net", "/en/x") and by_id[None]["rule"] == "net/" and (by_id[9]["host"], by_id[9]["path"]) == ("", "")


def test_url_rules_of_any_length(spark):
    rules = [Rule("a.com", "/x", "block"), Rule("b.a.com", "", "allow"), Rule("a.com", "/xyz/long", "allow")]
    df = spark.createDataFrame([(1, "http://a.com/xy"), (2, "http://b.a.com/x"), (3, "http://a.com/xyz/longer"), (4, "http://b.a.com")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter(df, rules).collect()} == {1: ("a.com/x", "block"), 2: ("b.a.com", "allow"), 3: ("a.com/xyz/long", "allow"), 4: ("b.a.com", "allow")}
    assert url_filter(df.limit(0), rules).count() == 0 and {r["verdict"] for r in url_filter(df, [], "block").collect()} == {"block"}


@pytest.mark.parametrize("name", ["op4_top_k", "op5_exact_dedup", "op6_mixing", "op7_url_filter"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))


def test_budgets_go_to_siblings_first(spark):
    rows = [(i, "w " * 10, "en", f"s{i % 2}") for i in range(20)] + [(100 + i, "w " * 10, "de", "s9") for i in range(2)] + [(200 + i, "w " * 10, "fr", "s5") for i in range(40)]
    domain = F.when(F.col("lang") == "fr", "b").otherwise("a")
    plan = Mixture(budget=200, weights={"domain": {"a": 1, "b": 1}, "language": {"en": 1, "de": 3}})
    got = mix(frame(spark, rows), plan, domain, word_count(F.col("text"))).collect()
    taken = lambda lang: sum(r["copies"] * r["n_tokens"] for r in got if r["language"] == lang)
    # Of a's 100 de is due 75 and has 20; en, its sibling, gets the rest; b keeps its own 100.
    assert (taken("de"), taken("en"), taken("fr")) == (20, 80, 100)
    more = Mixture(budget=500, weights=plan.weights)
    got = mix(frame(spark, rows), more, domain, word_count(F.col("text"))).collect()
    assert (taken("de"), taken("en"), taken("fr")) == (20, 200, 280)  # a is full, so b gets what a can't use


def test_epochs_and_edges(spark):
    rows = [(1, "a b c", "en", "s"), (2, "d e", "en", "s"), (3, None, None, None), (4, "x y", "en", "t"), (None, "z", "en", "s"), (2, "d e", "en", "s")]
    plan = Mixture(budget=(2, 1), epochs=3, seed=1)
    got = mix(frame(spark, rows), plan, F.lit("d"), word_count(F.col("text"))).collect()
    assert len(got) == len(rows) and sum(r["n_tokens"] * r["copies"] for r in got) <= 20 and max(r["copies"] for r in got) <= 3
    out = take(frame(spark, rows), plan, F.lit("d"), word_count(F.col("text")))
    assert out.columns == frame(spark, rows).columns and out.count() == sum(r["copies"] for r in got)
    assert mix(frame(spark, []), plan, F.lit("d"), word_count(F.col("text"))).count() == 0
    a = {(r["doc_id"], r["copies"]) for r in mix(frame(spark, rows).repartition(3), plan, F.lit("d"), word_count(F.col("text"))).collect()}
    assert a == {(r["doc_id"], r["copies"]) for r in got}


def test_a_long_document_does_not_empty_its_leaf(spark):
    rows = [(i, "w " * 10, "en", "s") for i in range(20)] + [(100, "w " * 150, "en", "s")]
    for seed in range(6):
        plan = Mixture(budget=120, seed=seed, crossing=True)
        got = mix(frame(spark, rows), plan, F.lit("d"), word_count(F.col("text"))).collect()
        order = sorted(got, key=lambda r: (hashlib.md5(f"{seed}:1:{r['doc_id']}".encode()).hexdigest(), r["doc_id"]))
        want, total = [], 0
        for r in order:
            want.append(int(total < 120))
            total += r["n_tokens"]
        assert [r["copies"] for r in order] == want and sum(r["copies"] * r["n_tokens"] for r in got) >= 120
    assert corpus_pipeline.MIX_ONCE.crossing and not queries.MIXTURE.crossing


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>%s
<article><h1>Head</h1><p><b>One &lt;two&gt;<br><p>Thr<b>ee</b>&nbsp;&#233;</p><ul><li>x<li>y</ul><section class="comments"><p>nice</p></section><form>f</form></article>
<div id="cookie-notice">We use</div><footer>&copy; 2020</footer>"""


def test_main_text():
    assert main_text(PAGE % "<nav><p>menu</nav><div class='ad'>buy</div>") == "Head One <two> Three é x y"
    assert main_text("<div class='shadow'>keep</div><div class='ad-box'>no</div>") == "keep"
    assert main_text("<main>a<aside>b</aside></main>c") == "a" and main_text("x<!-- y -->z") == "xz" and main_text("") == ""
    assert main_text("<p>1 < 2 &am &ampx") == "1 < 2 &am &x" and main_text("<p a='>'>t</p><scr") == "t" and main_text("<div hidden>h</div>v") == "v"
    assert main_text("<div>" * 50_000 + "deep") == "deep"
    assert main_text("<article><header><p>By X</p></header><p>t</p></article>") == "t"


@pytest.mark.parametrize("page", ["<b>" * 180_000 + "</i>" * 120_000 + "end", "<p><div>" + "<b>" * 180_000 + "<p>x" * 120_000 + "end", "<a <b " * 170_000 + "end", "<div class='" * 90_000 + "end"], ids=["stray", "blocks", "broken", "quotes"])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 20  # a scan of the open elements for each tag would take half an hour


class Plain(HTMLParser):
    """Text in article elements outside what pages set aside, by the standard library's parser."""

    ASIDE = {"nav", "aside", "footer", "header", "form", "script", "style", "button", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag not in html_text.VOID:
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            self.open.append((tag, tag in self.ASIDE or tag in ("div", "section", "ul") and html_text.name_of_box(named) != ""))
        if tag not in html_text.INLINE:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass
        if tag not in html_text.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(aside for _, aside in self.open):
            self.out.append(data)


def test_pages_match_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for r in pages.collect():
        other = Plain()
        other.feed(r["html"] or "")
        other.close()
        assert got[r["page_id"]] == " ".join("".join(other.out).split())


def test_templates_are_found_by_count(spark):
    boxes = "<div><p>Site name</p><p>Every page says this</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{boxes}<div><p>Text {i}</p></div></body></html>") for i in range(10)]
    rows += [(50, "http://few.example/1", f"<body>{boxes}<p>own</p>"), (51, None, None), (None, "http://h.example/0", rows[0][2])]
    rows += [(60 + i, f"http://copy.example/{i}", f"<body>{boxes}<article><p>The same article</p></article>") for i in range(8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert all(got[i] == f"Text {i}" for i in range(10)) and got[None] == "Text 0"
    assert got[50] == "Site name Every page says this own" and got[51] == "" and all(got[60 + i] == "The same article" for i in range(8))
    assert extract(df.limit(0)).count() == 0 and all(r["n_chars"] == len(r["text"]) for r in extract(df).collect())


def test_templates_in_articles(spark):
    box, line = "<div><p>Join our list</p></div>", "<p>All rights are with the author</p>"
    story = [f"<p>Story {i} has a text of its own, longer than the box beside it is</p><p>and a second part {i}</p>" for i in range(12)]
    rows = [(i, f"http://h.example/{i}", f"<body><{tag}><h1>Daily</h1>{story[i]}{box}{line}</{tag}>") for i, tag in enumerate(["article", "main"] * 6)]
    copied = "<article><div><p>First part of it</p></div><div><p>The middle part</p></div><div><p>The last part</p></div></article>"
    rows += [(100 + i, f"http://h.example/copy/{i}", f"<title>{i}</title>{copied}") for i in range(8)]
    rows += [(200 + i, f"http://h.example/code/{i}", f"<article>{story[i]}<div><pre>run it</pre></div></article>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = [main_text(s) for s in story]
    assert all(got[i] == f"Daily {own[i]} All rights are with the author" for i in range(12))
    assert all(got[100 + i] == "First part of it The middle part The last part" and got[200 + i] == f"{own[i]} run it" for i in range(8))


def test_templates_of_a_section(spark):
    text = [f"<div><p>Page {i} tells of matter {i * i} at some length, as pages do</p></div>" for i in range(100)]
    notice, line = "<div><p>Aviso legal</p></div>", "<p>So it goes</p>"
    rows = [(i, f"http://h.example/{i}", f"<body>{notice if i < 6 else ''}{text[i]}{line if i < 9 else ''}") for i in range(100)]
    rows += [(200 + i, f"http://h.example/copy/{i}", f"<body><div>The same long story on some pages</div><p>{i}</p>") for i in range(6)]
    rows += [(300, "http://h.example/r", "<body><div><div>A page that is</div><div>in the table often</div></div>")] * 30
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == main_text(text[i]) + (" So it goes" if i < 9 else "") for i in range(100))
    assert all(got[200 + i] == f"The same long story on some pages {i}" for i in range(6)) and got[300] == "A page that is in the table often"


def test_subtree_hashes_are_stable():
    a, b = (html_text.subtrees(f"<div>  A <p>b</p></div>{x}") for x in ("", "<nav><ul><li>q</ul></nav>"))
    assert a < b and html_text.subtrees("<article><p>x</p></article>") == set()


NAMES = "row key score predicted gone_id class_id kept digest salt copies copy domain language n_tokens all".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name, tmp_path_factory):
    """Nulls, empty and very long texts, repeated rows, clashing names, a map; and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = [(1, "plain words of a text that is all right", "en", "src1", 40), (1, "plain words of a text that is all right", "en", "src1", 40), (2, None, None, None, None), (None, "no id", "fr", "src2", 5)]
    odd += [(3, "", "de", "src7", 0), (4, "long words " * 200_000, "en", "src1", 2_200_000), (5, "a", None, "src99", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit("x") for n in NAMES} | {"more": F.create_map(F.lit("k"), F.col("doc_id"))})
    where = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(3, 1, 0), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    got = stage(spark, docs, where)
    assert got.count() <= len(odd) and stage(spark, docs.limit(0), where).count() == 0
    if name == "bpe":
        assert got.count() == len(odd) and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    else:
        assert got.schema.names == docs.columns
    ids = sorted(str(r["doc_id"]) for r in got.collect())
    if name == "exact dedup":
        assert ids == ["1", "2", "4", "5", "None"]
    if name == "near dedup":
        assert ids == ["1", "2", "3", "4", "5", "None"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF))
        assert seen[-1].columns == docs.columns
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    left = {r["doc_id"] for r in seen[1].select("doc_id").collect()}
    assert len(toxic & left) < len(toxic)
    texts = [r["text"] for r in seen[2].collect()]
    assert len({"".join(t.split()) for t in texts}) == len(texts)
    codec = Codec(open(queries.vocabulary(), encoding="utf-8").read())
    want = {r["doc_id"]: len(codec.encode(r["text"])) for r in seen[-1].collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == want
