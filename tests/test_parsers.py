import json

import pytest

from lakeleaf.sources import folders, htmlpage, markdown, openapi, paths, web
from lakeleaf.sources.globs import Patterns, matches, string_list
from lakeleaf.sources.model import digest


def test_markdown_sections_nest():
    d = markdown.parse("guide.md", b"# Product\nIntro\n\n## Setup\nInstall\n\n### Details ###\nMore\n")
    assert d.title == "Product"
    assert [s.heading_path for s in d.sections] == [["Product"], ["Product", "Setup"], ["Product", "Setup", "Details"]]
    assert [s.content for s in d.sections] == ["Intro\n\n", "Install\n\n", "More\n"]
    assert [s.hash for s in d.sections] == [digest(s.content) for s in d.sections]
    assert [s.ordinal for s in d.sections] == [0, 1, 2]


def test_markdown_without_headings_is_one_section():
    d = markdown.parse("a/reference.markdown", b"No headings\n")
    assert (d.title, d.sections[0].title, d.sections[0].heading_path) == ("reference.markdown", "reference.markdown", [])


def test_markdown_empty_heading_and_skipped_level():
    d = markdown.parse("empty.md", b"#\nBody\n")
    assert (d.title, d.sections[0].title) == ("empty.md", "")
    d = markdown.parse("x.md", b"\n\n# A\n### C\n")
    assert [s.heading_path for s in d.sections] == [["A"], ["A", "C"]]


@pytest.mark.parametrize(
    ("line", "found"),
    [("# A", (1, "A")), ("   ###### B ##", (6, "B")), ("####### C", None), ("#D", None), ("    # E", None), ("##", (2, "")), ("# F#", (1, "F#")), ("#\tG", (1, "G"))],
)
def test_atx_rules(line, found):
    assert markdown.heading(line) == found


def test_html_sections_links_anchors():
    page = b"""<html><head><title>API Guide</title><script>var x="<p>no</p>"</script></head><body><nav id="menu"><a href="skip.html">no</a></nav>
    <main id="main-content"><h1 id="overview">Overview</h1><p>Intro <a href="details.html#quota">quota</a></p><h2 id="api">API</h2><ul><li>One</li><li>Two <a href="../guide">guide</a>
    <a href="https://x.example/">out</a></ul></main></body></html>"""
    d = htmlpage.parse("docs/api.html", page)
    assert d.title == "API Guide"
    assert [(s.title, s.heading_path, s.anchor) for s in d.sections] == [("Overview", ["Overview"], "overview"), ("API", ["Overview", "API"], "api")]
    assert d.sections[1].content == "One\nTwo guide out"
    assert [[x.href for x in s.links] for s in d.sections] == [["details.html#quota"], ["../guide"]]
    assert d.anchors == ["menu", "main-content", "overview", "api"]


def test_html_without_sections_and_leaf_boxes():
    assert htmlpage.parse("x.html", "<td>cell</td>").sections[0].content == "cell"
    assert htmlpage.parse("x.html", "<div>leaf <b>text</b></div><div>out<p>in</p></div>").sections[0].content == "leaf text\nin"


@pytest.mark.parametrize(("href", "ok"), [("#a", True), ("a/", True), ("a.html?x#y", True), ("guide", True), ("a.pdf", False), ("mailto:x@y", False), ("https://x/", False), ("", False), ("data:x", False)])
def test_internal_links(href, ok):
    assert htmlpage.is_internal(href) is ok


SPEC = {
    "openapi": "3.0.0", "info": {"title": "Benefits"},
    "paths": {
        "/member/benefits": {"get": {"operationId": "listBenefits", "tags": ["member"], "summary": " List ", "parameters": [{"$ref": "#/components/parameters/Page"}, {"name": "q", "in": "query", "required": True, "schema": {"type": "string"}}],
                                     "responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Benefit"}}}}}, "404": {"$ref": "#/components/responses/Missing"}}}},
        "/member/benefits/redeem": {"post": {"requestBody": {"required": True, "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Benefit"}}}}}, "x-note": {}},
    },
    "components": {"parameters": {"Page": {"name": "page", "in": "query", "schema": {"type": "integer", "format": "int32"}}}, "schemas": {"Benefit": {"type": "object", "description": "a benefit"}}, "responses": {"Missing": {"description": "none"}}},
}


def test_openapi_json_and_yaml_agree():
    yaml = pytest.importorskip("yaml")
    a, b = openapi.parse("spec.json", json.dumps(SPEC).encode()), openapi.parse("spec.yaml", yaml.safe_dump(SPEC).encode())
    assert [s.content for s in a.sections] == [s.content for s in b.sections]
    assert [s.title for s in a.sections] == ["GET /member/benefits", "POST /member/benefits/redeem"]
    assert a.sections[0].content == (
        "GET /member/benefits\noperationId: listBenefits\ntags: member\nsummary: List\nparameters:\n- page in query schema: integer int32\n- q in query required schema: string\n"
        "responses:\n- 200 ok\n  content application/json schema: array items Benefit object a benefit\n- 404 none\n"
    )
    assert a.sections[1].content == "POST /member/benefits/redeem\nrequestBody: required\n  content application/json schema: Benefit object a benefit\n"
    with pytest.raises(ValueError, match="JSON"):
        openapi.parse("bad.json", b"{")


def test_globs():
    assert matches(["**/*.md"], "a/b.md") and matches(["**/*.md"], "b.md") and not matches(["*.md"], "a/b.md")
    assert matches(["docs/**"], "docs/x/y") and matches(["**/build/**"], "a/build/x") and not matches(["**/build/**"], "a/builder/x")
    assert matches(["docs/**/skip.md"], "docs/a/b/skip.md") and matches(["[ab].txt"], "a.txt") and not matches(["[", ""], "[")
    p = Patterns.of({"include": ["**/*.md"], "exclude": "**/skip.md, x/**"})
    assert [p.wanted(x) for x in ("keep.md", "a/skip.md", "x/y.md", "node_modules/a.md", ".git/a.md", "a.txt")] == [True, False, False, False, False, False]
    assert string_list(["a,b", " c "]) == ["a", "b", "c"] and string_list("a, b") == ["a", "b"]


@pytest.mark.parametrize(("dsn", "path"), [("/a/../b", "/b"), ("file:///docs", "/docs"), ("C:\\x\\y", "/mnt/c/x/y"), ("file:///D:/x", "/mnt/d/x"), ("\\\\wsl$\\Ubuntu\\home\\me", "/home/me")])
def test_local_paths(dsn, path):
    assert paths.local_path(dsn) == path


def test_paths_and_candidates():
    for bad in ("", "file://", "https://x"):
        with pytest.raises(ValueError):
            paths.local_path(bad)
    assert paths.document_url("https://x/", "a.md") == "https://x/a.md" and paths.document_url("/r", "a.md") == "/r/a.md" and paths.document_url("", "a") == "a"
    assert paths.href_candidates("docs/index.html", "details.html#quota?x") == ["docs/details.html#quota", "details.html#quota"]
    assert paths.href_candidates("a/b.html", "/guide/") == ["guide#", "guide/index.html#", "guide.html#"]
    assert "cooperate/bug#" in paths.href_candidates("cooperate/bug/index.html", "/cooperate/bug/index.html")
    assert paths.href_candidates("a/b.html", "#x") == ["a/b.html#x"]


class FakeRemote:
    files = {"/docs/a.md": b"# A", "/docs/b.html": b"<p>b", "/docs/c.bin": b"x", "/docs/node_modules/d.md": b"no", "/docs/sub/e.txt": b"e"}

    def walk(self, root):
        for path in sorted(self.files):
            yield path, False

    def read(self, path):
        return self.files[path]

    def close(self):
        pass


def test_mirror_drops_stale_files(tmp_path):
    (tmp_path / "old.md").write_text("old")
    out = folders.Mirror("sftp://me@host/docs", "src", json.dumps({"cache": str(tmp_path)}), lambda a, c: FakeRemote()).sync()
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a.md", "b.html", "sub/e.txt"]
    assert out.url == "sftp://me@host:22/docs"
    for bad in ("http://x/y", "sftp://me@host", ""):
        with pytest.raises(ValueError):
            folders.RemoteAddress.of(bad)


def test_scans(spark, tmp_path):
    for name, text in {"keep.md": "# K\n", "a/page.html": "<h1>P</h1>", "a/n o te.txt": " t \n", "vendor/x.md": "# no", ".hid/x.md": "# no", "b.tmp": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [r["path"] for r in folders.scan_markdown(spark, str(tmp_path)).collect()] == ["keep.md"]
    rows = {r["path"]: r for r in folders.scan_static(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a/n o te.txt", "a/page.html", "keep.md"]
    assert rows["a/n o te.txt"]["sections"][0]["content"] == "t"
    assert [r["path"] for r in folders.scan_html(spark, str(tmp_path)).collect()] == ["a/page.html"]
    with pytest.raises(ValueError, match="name no document"):
        folders.scan_static(spark, str(tmp_path), '{"include": "**/*.none"}')
    with pytest.raises(ValueError, match="there is no folder"):
        folders.scan_static(spark, str(tmp_path / "gone"))


def test_git_checkout(tmp_path):
    root = tmp_path / "repo"
    (root / "docs").mkdir(parents=True)
    (root / "docs/a.md").write_text("# A")
    for args in (["init", "-q", "-b", "main"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        folders._git(str(root), *args)
    assert folders.checkout(str(root), '{"path": "docs", "branch": "main"}').root == str(root / "docs")
    with pytest.raises(ValueError, match="other"):
        folders.checkout(str(root), '{"branch": "other"}')
    with pytest.raises(ValueError, match="configure cache"):
        folders.checkout("https://x/y.git")
    cache = tmp_path / "cache"
    assert folders.checkout(str(root), json.dumps({"cache": str(cache), "branch": "main"})).root == str(cache)


PAGES = {
    "https://h/docs": '<title>Docs</title><h1>Docs</h1><p><a href="/docs/guide#start">G</a> <a href="missing/">x</a> <a href="/other">o</a> <a href="https://e/">e</a>',
    "https://h/docs/guide": '<title>Guide</title><h1 id="start">Guide</h1><p>text <a href="/docs">back</a>',
}


def fetch(url, headers):
    body = PAGES.get(url)
    return web.Response(200 if body else 404, {"Content-Type": "text/html"}, (body or "").encode())


def test_crawl(spark):
    rows = {r["path"]: r for r in web.Site("https://h/docs", transport=fetch).load(spark).collect()}
    assert sorted(rows) == ["guide/index.html", "index.html"]
    assert [x["href"] for x in rows["index.html"]["sections"][0]["links"]] == ["guide/index.html#start"]
    assert [r["path"] for r in web.Site("https://h/docs", '{"max_pages": "1"}', fetch).load(spark).collect()] == ["index.html"]
    with pytest.raises(ValueError, match="404"):
        web.Site("https://h/none", transport=fetch).load(spark)
    assert web.Site("h/x", '{"bearer_token": "t", "cookie": "a=1", "headers_json": "{\\"X\\": \\"1\\"}"}').headers == {"Authorization": "Bearer t", "Cookie": "a=1", "X": "1"}


def test_script_pages_and_routes():
    shell = b'<div id="app"></div><noscript>Enable JavaScript</noscript>'
    assert web.is_script_page(shell) and web.is_script_page(b'<div id="root"></div><script src="/chunk-vendors.js"></script>')
    assert web.is_script_page(b'<div id="app"></div><!--' + b"x" * 600 + b"-->") and not web.is_script_page(b"<p>" + b"words " * 100 + b"</p>")
    links = web.page_links('<a href="#/guide">g</a><a href="/app/home/#/x">x</a><a href="#contact">c</a>', "https://h/", "https://h/", "/", routes=True)
    assert [u for u, _, _ in links] == ["https://h/guide", "https://h/x"]
    assert web.script_base(b'<base href="/app/home/">') == "/app/home/" and web.script_base(b'<a href="/docs/a#/x">a</a><a href="/docs/b#/y">b</a>') == "/docs"
    assert web.script_base(b"<p>") == "/"
    assert web.merged_links([("u", "", "a")], [("u", "", "b"), ("v", "", "c")]) == [("u", "", "a"), ("v", "", "c")]


def wiki(url, headers):
    assert headers["Authorization"].startswith("Basic ")
    if "child/page" in url:
        return web.Response(200, {"Content-Type": "application/json"}, json.dumps({"results": [{"id": "200"}] if "/100/" in url else []}).encode())
    if "/404" in url:
        return web.Response(404, {}, b"")
    page = "100" if "/100" in url else "200"
    return web.Response(200, {"Content-Type": "application/json"}, json.dumps({"id": page, "title": f"Page {page}", "version": {"number": 3}, "body": {"storage": {"value": "<h1>T</h1><p>GET /wiki/x</p>"}}, "_links": {"webui": f"/p/{page}"}}).encode())


def test_wiki_pages(spark):
    w = web.Wiki("https://w/base", '{"username": "u", "api_token": "t", "page_id": "100", "include_children": true}', wiki)
    rows = w.load(spark).collect()
    assert [(r["path"], r["url"], r["version"]) for r in rows] == [("100.html", "https://w/base/p/100", "3"), ("200.html", "https://w/base/p/200", "3")]
    assert [p["parent_id"] for p in w.pages()] == ["", "100"]
    with pytest.raises(ValueError, match="404"):
        w.pages(["404"])
    for status, words in ((401, "refuses"), (302, "login"), (500, "HTTP 500")):
        with pytest.raises(ValueError, match=words):
            web.Wiki("https://w", "", lambda u, h, s=status: web.Response(s, {"Location": "l"}, b"")).pages(["1"])
    with pytest.raises(ValueError, match="not JSON"):
        web.Wiki("https://w", "", lambda u, h: web.Response(200, {"Content-Type": "text/html"}, b"x")).pages(["1"])
