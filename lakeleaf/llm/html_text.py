"""Operator 9, HTML extraction by site template removal.

Pass 1 hashes the element subtrees of every page and counts, in Spark, on how many unlike pages of its host each
occurs. Pass 2 reads every page again with those of its own subtrees that recur, deletes these, and gives the text of
what is left of the article. What one page alone can tell (navigation, scripts, forms, boxes named as adverts or
comments) goes too, so pages of hosts with few pages come out clean.

Within an article boxes are counted, not paragraphs, headings or tables: lines that recur there are the authors' own.
Whole articles are copied between pages of a host, and they are what is asked for. So a box counts once for all copies
of an article, and what holds most of an article's text is never deleted.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import materialise, salt
from lakeleaf.llm.url_filter import url_parts

#: A box is template if it occurs beside so many unlike texts of its host. A paragraph, or what is most of its page,
#: must also occur on this share of the host's pages: it may be a line that authors repeat, or a copied story.
LEAST_PAGES, LEAST_SHARE = 5, 0.2

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form button select textarea iframe object svg canvas audio video dialog menu title".split())
#: Words that name a box beside the article, alone or with words of PLAIN only. "site-footer" and
#: "related-posts" are such names; "no-sidebar", "related-work" and "search-engines" are not.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices sidebar aside menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond "
    "share sharing social related newsletter subscribe popup modal footer masthead widget contentinfo complementary search".split()
)
PLAIN = frozenset(
    "area article articles bar block body bottom box button buttons col column container content entry form global head header icons inner item items left link links list main media new page panel post posts primary reader readers "
    "right row secondary section site slot tag text thread top unit user users wrap wrapper".split()
)
COMMENTS = frozenset("comment comments disqus respond".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that carry an article's own matter; others are boxes, unless in an article they hold one of MATTER.
MATTER = frozenset("blockquote code figure math pre table".split())
PROSE = MATTER | frozenset("address caption col colgroup dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr li p tbody td tfoot th thead tr".split())


class Element:
    __slots__ = ("tag", "beside", "article", "named", "parts")

    def __init__(self, tag: str, beside: bool, article: bool, named: str = ""):
        self.tag, self.beside, self.article = tag, beside, article
        self.named = named  # "box" or "comments" if only its name (or being a form) puts it beside the article
        self.parts: list[Element | str] = []  # children and text, in order


def name_of_box(names: str) -> str:
    """What the names in class, id and role say: "comments", "box", or nothing."""
    found = ""
    for name in names.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if any(w in BESIDE for w in words) and all(w in BESIDE or w in PLAIN or w.isdigit() for w in words):
            if not COMMENTS.isdisjoint(words):
                return "comments"
            found = "box"
    return found


def boxed(tag: str, raw: str) -> tuple[bool, bool, str]:
    """Whether an element is put beside the article, by its tag, its names or its being hidden; whether it is an article;
    and, if its name alone decides, how it is named. Articles, inline elements, headings, paragraphs and the like are
    never boxes by their names."""
    beside, article, named = tag in DROPPED, tag in ARTICLE, ""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw.strip() else {}
    article = article or found.get("role", "").lower() == "main"
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    if tag == "form":
        named = "box"
    elif found and not (beside or article or tag in INLINE or tag in PROSE or tag in ("body", "html")):
        named = name_of_box(" ".join(found.get(k, "") for k in ("class", "id", "role")))
    if hidden:
        return True, article, ""
    return (beside or named != "") and not article, article, "" if article else named


def parse(page: str) -> Element:
    """A tree of elements and decoded text. End tags close what is open in them; unknown end tags are skipped."""
    root = Element("", False, False)
    # Open elements, the places of the blocks among them, and how many are open of each name: no tag scans the stack.
    stack, blocks, opened, at = [root], [0], Counter(), 0

    def close(depth: int) -> None:
        opened.subtract(e.tag for e in stack[depth:])
        del stack[depth:]
        while blocks[-1] >= depth:
            blocks.pop()

    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            stack[-1].parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            if tag not in INLINE:
                stack[-1].parts.append(" ")
        else:
            if tag == "p" or tag == "li":  # these end the open one before them
                if stack[blocks[-1]].tag == tag:
                    close(blocks[-1])
            e = Element(tag, *boxed(tag, m[3]))
            stack[-1].parts.append(e)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
            if tag not in VOID:
                opened[tag] += 1
                if tag not in INLINE:
                    blocks.append(len(stack))
                stack.append(e)
    if at < len(page):
        stack[-1].parts.append(html.unescape(page[at:]))
    settle(root)
    return root


def settle(root: Element) -> None:
    """Take back what names alone have decided, where it would lose the article: a form or box round the only articles,
    and one that holds most of its article's text (of the page's, if there is no article). Comments may be longer than
    what they are about, and stay aside."""
    order = [e for e, _ in walk(root)]
    size: dict[int, int] = {}
    for e in reversed(order):
        hard = e.beside and not e.named
        size[id(e)] = 0 if hard else sum(len("".join(c.split())) if isinstance(c, str) else size[id(c)] for c in e.parts)
    if not has_article(root):
        best: tuple[int, list[Element]] = (-1, [])
        todo: list[tuple[Element, list[Element]]] = [(root, [])]
        while todo:
            e, above = todo.pop()
            if e.beside and not e.named or e.named == "comments":
                continue
            above = [*above, e] if e.beside else above
            if e.article:
                best = max(best, (size[id(e)], above), key=lambda x: x[0])
            else:
                todo.extend((c, above) for c in e.parts if not isinstance(c, str))
        for e in best[1]:
            e.beside = False
    wanted = has_article(root)
    walked: list[tuple[Element, int]] = [(root, 0 if wanted else size[id(root)])]
    while walked:
        e, whole = walked.pop()
        if e.article:
            whole = whole or size[id(e)]
        if e.beside and e.named == "box" and whole and 2 * size[id(e)] > whole:
            e.beside = False
        if not e.beside:
            walked.extend((c, whole) for c in e.parts if not isinstance(c, str))


def walk(root: Element) -> Iterator[tuple[Element, bool]]:
    """Every element once, with whether it lies in an article; without recursion, as pages may nest deeply."""
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        yield e, inside
        todo.extend((c, inside or e.article) for c in e.parts if not isinstance(c, str))


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def hashes(root: Element) -> dict[int, int]:
    """The 64-bit hash of every element's subtree (names, text with white space made one), by id of the element."""
    found: dict[int, int] = {}
    for e in reversed([e for e, _ in walk(root)]):
        text = " ".join("".join(c if isinstance(c, str) else f"\x00{found[id(c)]}\x00" for c in e.parts).split())
        found[id(e)] = digest(f"{e.tag}\x01{text}")
    return found


def holds_article(root: Element) -> set[int]:
    """Ids of the elements with an article in them."""
    held: set[int] = set()
    for e in reversed([e for e, _ in walk(root)]):
        if e.article or any(not isinstance(c, str) and id(c) in held for c in e.parts):
            held.add(id(e))
    return held


def sizes(root: Element) -> tuple[dict[int, int], set[int]]:
    """The signs of text, without white space and boxes beside the article, in every element, by id; ids of those with
    an element of MATTER in them."""
    size: dict[int, int] = {}
    matter: set[int] = set()
    for e in reversed([e for e, _ in walk(root)]):
        size[id(e)] = 0 if e.beside else sum(len("".join(c.split())) if isinstance(c, str) else size[id(c)] for c in e.parts)
        if e.tag in MATTER or any(not isinstance(c, str) and id(c) in matter for c in e.parts):
            matter.add(id(e))
    return size, matter


def has_article(root: Element) -> bool:
    """Whether there is an article that isn't itself in a box beside the main one; only its text is wanted then."""
    wanted, todo = False, [root]
    while todo and not wanted:
        e = todo.pop()
        if not e.beside:
            wanted = e.article
            todo.extend(c for c in e.parts if not isinstance(c, str))
    return wanted


def candidates(root: Element, held: set[int]) -> Iterator[tuple[Element, Element | None, bool, bool]]:
    """The elements that may be template, with their outermost article; whether each is a box that holds no more than
    half of the text of the article, or of the page; whether it goes anyhow. Nothing that holds more of an article is
    among them."""
    size, matter = sizes(root)
    wanted = has_article(root)
    todo: list[tuple[Element, Element | None, bool]] = [(root, None, False)]
    while todo:
        e, article, gone = todo.pop()
        gone = gone or e.beside
        if e.parts and e.tag not in INLINE and e.tag not in ("", "html", "body") and id(e) not in held:
            minor = e.tag not in PROSE and 2 * size[id(e)] <= size[id(article or root)]
            if article is None or minor and size[id(e)] and id(e) not in matter:
                yield e, article, minor, gone or wanted and article is None
        inner = article or (e if e.article else None)
        todo.extend((c, inner, gone) for c in e.parts if not isinstance(c, str))


def core(article: Element, size: dict[int, int], known: dict[int, int]) -> int:
    """The hash of the innermost element that holds most of an article's text."""
    e: Element | None = article
    while e is not None:
        found, e = e, next((c for c in e.parts if not isinstance(c, str) and 2 * size[id(c)] > size[id(article)]), None)
    return known[id(found)]


def occurrences(page: str) -> tuple[int, dict[tuple[int, int], tuple[bool, bool]]]:
    """The hash of the page's text; of each (subtree, text it stands beside) whether it is a box that is the lesser part,
    and whether it goes anyhow.

    In an article that text is the article's core, outside it is the page's.
    """
    root = parse(page)
    known, held, (size, _) = hashes(root), holds_article(root), sizes(root)
    whole = digest(shown(root, held))
    cores: dict[int, int] = {}
    found: dict[tuple[int, int], tuple[bool, bool]] = {}
    for e, article, minor, gone in candidates(root, held):
        if article is not None and id(article) not in cores:
            cores[id(article)] = core(article, size, known)
        key = known[id(e)], whole if article is None else cores[id(article)]
        before = found.get(key, (False, True))
        found[key] = before[0] or minor, before[1] and gone
    return whole, found


def subtrees(page: str) -> set[int]:
    """Hashes of the subtrees that may be template; each once."""
    return {subtree for subtree, _ in occurrences(page)[1]}


def shown(root: Element, held: set[int], deleted: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's text without the elements ``deleted`` (ids); blocks joined by one space."""
    wanted = has_article(root)
    out: list[str] = []
    work: list[tuple[Element | str, bool]] = [(root, False)]
    while work:
        e, inside = work.pop()
        if isinstance(e, str):
            if inside or not wanted:
                out.append(e)
            continue
        inside = inside or e.article
        if e.beside or id(e) in deleted:
            out.append(" " if e.tag not in INLINE else "")
            continue
        edge = "" if e.tag in INLINE else " "
        out.append(edge)
        if edge:
            work.append((edge, True))
        work.extend((c, inside) for c in reversed(e.parts))
    return " ".join("".join(out).split())


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The article's text without the subtrees in ``template``."""
    root = parse(page)
    held = holds_article(root)
    if not template:
        return shown(root, held)
    known = hashes(root)
    return shown(root, held, {id(e) for e, _, _, _ in candidates(root, held) if known[id(e)] in template})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points); one row per input row.

    A null html counts as empty and gives the empty text. A null url is on the empty host, like one without ``://``.
    Repeated rows, and pages with the same text, count once and are repeated in the result; other columns are ignored;
    an empty table gives an empty result. Very long pages are read whole, in time in proportion to their length.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(text), F.lit("")).alias("html"))
    # Copies of a page are dealt over salts, so that no task gets all of them.
    rows = rows.withColumn("host", F.coalesce(url_parts(F.col("url"))[0], F.lit(""))).withColumn("page", F.xxhash64("host", "html", salt("page_id", "url")))

    def list_subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            for host, page, text in zip(batch["host"], batch["page"], batch["html"]):
                whole, own = occurrences(text)
                found.append((host, page, 0, whole, -1, True))  # the page itself
                found += [(host, page, subtree, beside, int(minor), gone) for (subtree, beside), (minor, gone) in own.items()]
            out = pd.DataFrame(found, columns=["host", "page", "subtree", "beside", "minor", "gone"])
            yield out.astype({"host": "object", "page": "int64", "subtree": "int64", "beside": "int64", "minor": "int32", "gone": "bool"})

    seen = materialise(rows.select("host", "page", "html").mapInPandas(list_subtrees, "host string, page long, subtree long, beside long, minor int, gone boolean"), "html-subtrees")
    seen = seen.withColumn("salt", salt("beside"))
    hosts = seen.filter("minor < 0").select("host", "beside").distinct().groupBy("host").agg(F.count("*").alias("all_pages"))
    # Only what doesn't go anyhow is looked for; it counts wherever it occurs.
    asked = materialise(seen.filter("not gone"), "html-asked")
    each = seen.filter("minor >= 0").join(asked.select("host", "subtree").distinct(), ["host", "subtree"], "left_semi").groupBy("host", "subtree", "salt", "beside").agg(F.max("minor").alias("minor"))
    each = each.groupBy("host", "subtree", "salt").agg(F.count("*").alias("pages"), F.sum("minor").alias("minor"))
    sums = each.groupBy("host", "subtree").agg(F.sum("pages").alias("pages"), F.sum("minor").alias("minor")).filter(F.col("pages") >= LEAST_PAGES)
    often = sums.filter(F.col("minor") >= LEAST_PAGES).select("host", "subtree")
    # A host's number of pages goes to the salts that its subtrees have, so that a host with many isn't one task's.
    rest = sums.filter(F.col("minor") < LEAST_PAGES).withColumn("part", salt("subtree"))
    shares = rest.join(rest.select("host", "part").distinct().join(hosts, "host"), ["host", "part"]).filter(F.col("pages") >= F.col("all_pages") * LEAST_SHARE)
    recurring = each.select("host", "subtree", "salt").join(often.unionByName(shares.select("host", "subtree")), ["host", "subtree"])
    # Every page gets its own recurring subtrees only, however many its host has.
    template = asked.join(recurring, ["host", "subtree", "salt"]).groupBy("host", "page").agg(F.collect_set("subtree").alias("template"))
    template = materialise(template, "html-templates")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets: dict[bytes, frozenset[int]] = {}
            texts = []
            for page, own in zip(batch["html"], batch["template"]):
                key = b"" if own is None else own.tobytes()
                if key not in sets:
                    sets[key] = frozenset(() if own is None else own.tolist())
                texts.append(main_text(page, sets[key]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    met = rows.join(template.hint("merge"), ["host", "page"], "left").select("page_id", "url", "html", "template")
    kind = rows.schema["page_id"].dataType.simpleString()
    return met.mapInPandas(read, f"page_id {kind}, url string, text string, n_chars long")
