"""Operator 9: boxes by name, and counts of subtrees against a count in Python."""

import random
import time
from collections import defaultdict

import pytest

from lakeleaf.llm.html_text import LEAST_PAGES, LEAST_SHARE, extract, main_text, occurrences

STORY = "<p>The story is here and it is long enough.</p>"
TEXT = "The story is here and it is long enough."
KEPT = [
    '<div class="site no-sidebar"><article>{}</article></div>', '<div class="layout with-sidebar"><main><article>{}</article></main></div>', '<article class="post comments open">{}</article>',
    '<article class="post related-topic">{}</article>', '<main class="news social policy">{}</main>', '<article id="search-engines-explained">{}</article>', '<form id="aspnetForm"><article>{}</article></form>',
    '<article><section id="related-work">{}</section></article>', '<form>{}</form>', '<article><div class="content-widget">{}</div></article>', '<div class="widget"><article>{}</article></div><aside><article>teaser of another</article></aside>',
    '<div class="search"><article>{}</article></div><div class="comments"><article class="comment">A very long comment, longer than all that the story has to say.</article></div>',
]
GONE = [
    "<form><input>Search</form>", '<div class="share-buttons">Tweet</div>', '<div id="cookie-banner">ok?</div>', '<ul class="related-posts"><li>one</ul>', '<section class="comments">Nice one, really a long and winding comment, I do like it.</section>',
    '<div role="complementary">beside</div>', '<div class="ad-slot ad-1">buy</div>', '<div class="newsletter_box">mail</div>', "<nav>menu</nav>", "<aside>more</aside>", "<div hidden>no</div>", '<div class="site-footer">end</div>',
]


@pytest.mark.parametrize("page", KEPT)
def test_articles_stay(page):
    assert main_text(page.format(STORY)) == TEXT


@pytest.mark.parametrize("box", GONE)
def test_boxes_go(box):
    assert main_text(f"<article>{STORY}{box}</article>") == TEXT == main_text(f"<body>{box}{STORY * 1}</body>")


def test_inline_elements_and_headings_stay():
    assert main_text('<article><h2 id="social-history">Old</h2><p>We <span class="notice">must</span> go <a class="social">there</a>.</p></article>') == "Old We must go there."


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ('<div class="widget">' * 20000 + "x", "<form>" * 20000 + "<article>" + STORY, '<div class="ad"><p>' * 20000, "<article class='comments'>" * 20000):
        main_text(page)
    assert time.time() - began < 20


def test_counts_equal_brute_force(spark):
    rng = random.Random(12)
    boxes = [f"<div class=x{i}><p>Box {i} says the same</p></div>" for i in range(12)]
    rows = []
    for i in range(160):
        host = rng.choice(["big.example", "big.example", "small.example", "one.example"])
        story = f"<p>Story {rng.randrange(60)} of {host} with words {rng.randrange(60)}.</p>" + "<p>More of it, to be long.</p>" * rng.randrange(4)
        own = "".join(rng.sample(boxes[: rng.choice([3, 12])], rng.randrange(4)))
        page = f"<body>{own}<article>{story}{''.join(rng.sample(boxes, 2))}</article></body>" if i % 3 else f"<body>{own}<div>{story}</div></body>"
        rows.append((i, f"http://{host}/{i}", page))
    rows += [(500 + i, "http://big.example/copy", rows[0][2]) for i in range(30)]
    pages = {(u.split("/")[2], h) for _, u, h in rows}
    hosts, beside = defaultdict(set), defaultdict(lambda: defaultdict(bool))
    for host, page in pages:
        whole, found = occurrences(page)
        hosts[host].add(whole)
        for (subtree, by), (minor, _) in found.items():
            beside[host, subtree][by] |= minor
    template = {k for k, v in beside.items() if len(v) >= LEAST_PAGES and (sum(v.values()) >= LEAST_PAGES or len(v) >= len(hosts[k[0]]) * LEAST_SHARE)}
    want = {i: main_text(h, frozenset(s for host, s in template if host == u.split("/")[2])) for i, u, h in rows}
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want and template and sum(main_text(h) != want[i] for i, _, h in rows) > 20
