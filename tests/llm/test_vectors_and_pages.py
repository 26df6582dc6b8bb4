from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvergrain.llm import html_text, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=10):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, []).append(np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int).tolist())
    out = []
    for q in queries:
        if q in fine:
            v = fine[q][0]
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, ws in fine.items() if i != q for w in ws)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("n", [3, 40, 600])
def test_top_k(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k * 10, rng.normal(size=8).astype(np.float32).tolist()) for k in range(n)]
    rows += [(7, [0.5] * 8), (8, [0.5] * 8), (9, [0.5] * 8), (11, None), (12, [None] * 8), (13, [float("nan")] * 8), (14, [float("inf")] + [0.0] * 7), (15, [1.0, 2.0]), (None, [1.0] * 8), (200, [0.1] * 8) if n > 50 else (201, [0.1] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    got = topk.top_k(df, df.where("vec_id % 100 = 0 and vec_id <> 200"))
    want = brute([(i, v) for i, v in rows], [i for i, _ in rows if i is not None and i % 100 == 0 and i != 200])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_one_vector_for_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    rng = np.random.default_rng(1)
    rows = [(k, ([0.25] * 8 if k % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist())) for k in range(900)]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    got = topk.top_k(df, df.where("vec_id % 100 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, range(0, 900, 100))


def test_large_components_and_fine_rings(spark, monkeypatch):
    """Sums beyond 2**53, an id with two vectors, and annuli of a few rows, each asked by a few queries at a time."""
    monkeypatch.setattr(topk, "BLOCK", 20)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=6) * (1e5 if k % 2 else 1)).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, [1e6, 1e6 + k / 1024, -1e6, 1.0, 0.0, 0.5]) for k in range(12)] + [(2000, [1e4] + [0.0] * 5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"))
    want = []
    fine = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q in (i for i in fine if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert max(abs(x[3]) for x in want) > 2**53
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    twice = spark.createDataFrame([(0, [2.0, 1.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], VECTORS)
    for order in ("embedding", "vec_id"):
        d = twice.orderBy(F.desc(order))
        assert [tuple(r) for r in topk.top_k(d, d.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2, 2 << 20), (0, 2, 1, 1 << 20)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], VECTORS)
    assert topk.top_k(df, df).count() == 0
    df = spark.createDataFrame([(1, None, 1)], VECTORS)
    assert topk.top_k(df, df).count() == 0


PAGES = "page_id long, url string, html string"


def text_of(spark, *pages):
    return {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(list(pages), PAGES)).collect()}


def test_marked_article(spark):
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>H</header><nav><ul><li>n</li></ul></nav>
    <div class="ad">buy</div><article><h1>Title &amp;  more</h1><p>One<b>two</b>&nbsp;three<br>four</p><!-- <p>no</p> --><aside>s</aside>
    <form>f<button>b</button></form><ul><li>1<li>2</ul><div role="comment"><p>first!</p></div><p>last</article><footer>&copy;</footer></body></html>"""
    assert text_of(spark, (1, "http://h/a", page)) == {1: "Title & more\nOnetwo three\nfour\n1\n2\nlast"}


def test_pages_without_marks_lose_shared_lines(spark):
    frame = "<div>Site name</div><div>Menu entry</div>{}<div>Imprint</div>"
    pages = [(k, f"http://h.example/en/{k}", frame.format(f"<p>Story {k} begins</p><p>and ends {k}</p>")) for k in range(4)]
    assert text_of(spark, *pages) == {k: f"Story {k} begins\nand ends {k}" for k in range(4)}


def test_copies_of_a_page_keep_their_text(spark):
    page = "<p>The same story</p><p>with the same end</p>"
    assert set(text_of(spark, (1, "http://h/a?x=1", page), (2, "http://h/a?x=2", page)).values()) == {"The same story\nwith the same end"}


def longest(a, b):
    """Places in a of a longest common subsequence, by the table."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif d[i - 1][j] >= d[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def plain_differences(pages):
    """pages: (id, host, path, lines, whether in an article) -> {id: text}, page by page."""
    first = {}
    for i, host, path, lines, article in pages:
        key = host, tuple(lines), article
        first[key] = min(first.get(key, (path, i)), (path, i))
    order = sorted((key[0], *at, key) for key, at in first.items())
    runs = []
    for k, (host, *_, key) in enumerate(order):
        both = set(key[1]) & set(order[k - 1][3][1]) if k and order[k - 1][0] == host else set()
        either = set(key[1]) | set(order[k - 1][3][1])
        if 5 * sum(map(len, both)) >= 4 * sum(map(len, either)) and both:
            runs[-1].append(k)
        else:
            runs.append([k])
    hosts = [o[0] for o in order]
    units = [u for run in runs for u in ([run] if len(run) > 1 and 2 * len(run) <= hosts.count(hosts[run[0]]) else [[k] for k in run])]
    assert any(len(u) > 1 for u in units)
    text = {}
    for at, (host, *_, key) in ((n, order[k]) for n, u in enumerate(units) for k in u):
        lines, article = list(key[1]), key[2]
        others = [list(order[units[k][0]][3][1]) for s in (1, 2, 4, 8) for k in (at - s, at + s) if 0 <= k < len(units) and hosts[units[k][0]] == host]
        votes = [0] * len(lines)
        for o in others:
            for k in longest(lines, o):
                votes[k] += 1
        if article:
            gone = {k for k, v in enumerate(votes) if v == len(others) > 2}
        else:
            gone = {k for k, v in enumerate(votes) if 2 * v > len(others)}
        text[key] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return {i: text[host, tuple(lines), article] for i, host, path, lines, article in pages}


@pytest.mark.parametrize("parts", [1, 4, 40, 211])
def test_differences_equal_a_plain_version_with_any_number_of_tasks(spark, monkeypatch, parts):
    monkeypatch.setattr(html_text, "BLOCK_PAGES", 20)
    random.seed(12)
    frame = [f"Frame line {k:02d}" for k in range(12)]
    pages = []
    for i in range(150):
        host = random.choice(["h.example", "h.example", "k.example", "single.example"]) if i else "alone.example"
        lines = sorted(random.sample(frame, random.choice([2, 9, 11, 12])))
        for k in range(random.randint(0, 4)):
            lines.insert(random.randint(0, len(lines)), f"Story {i if random.random() < 0.8 else i % 7} part {k}")
        lines = list(dict.fromkeys(lines))
        pages.append((i, host, f"/{random.choice('abc')}/{i % 60}", lines, random.random() < 0.4))
        if random.random() < 0.1:
            pages.append((1000 + i, host, f"/copy/{i}", lines, pages[-1][4]))
    wrap = lambda lines, article: ("<article>{}</article>" if article else "{}").format("".join(f"<p>{x}</p>" for x in lines))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = text_of(spark, *[(i, f"http://{host}{path}", wrap(lines, article)) for i, host, path, lines, article in pages])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == plain_differences(pages)


def test_short_articles_in_a_large_frame(spark):
    """Forty menu lines and one line of story; two versions of one page among others keep their story."""
    menu = "".join(f"<div>Menu entry number {k} of the site</div>" for k in range(40))
    pages = [(k, f"http://s/{k}", menu + f"<p>A short notice, number {k}</p>") for k in range(4)]
    assert text_of(spark, *pages) == {k: f"A short notice, number {k}" for k in range(4)}
    story = "".join(f"<p>Sentence {k} of a longer story</p>" for k in range(60))
    pages += [(10 + k, f"http://s/b/{k}", menu + f"<p>Printed on day {k}</p>" + story) for k in range(2)]
    got = text_of(spark, *pages)
    assert got[10] == "\n".join(["Printed on day 0", *(f"Sentence {k} of a longer story" for k in range(60))]) and got[2] == "A short notice, number 2"


def test_menus_inside_main_and_versions_of_a_page(spark):
    """Forty menu lines in main go from 12 and 6 pages, one partner's word isn't enough; 12 versions of a page keep their article where they aren't the host."""
    menu = "".join(f"<div>Menu entry number {k} of the site</div>" for k in range(40))
    pages = [(100 * n + k, f"http://m{n}/{k:02d}", f"<main>{menu}<p>The only line of story {k}</p></main>") for n in (12, 6, 2) for k in range(n)]
    story = [f"Paragraph {k} of the article that has a counter below it" for k in range(10)]
    version = lambda k: "<article>" + "".join(f"<p>{x}</p>" for x in story) + f"<p>Seen {k} times</p></article>"
    pages += [(5000 + k, f"http://v/a/{k:02d}", version(k)) for k in range(40)]
    pages += [(6000 + k, f"http://v/b/{k:02d}", f"<article><p>Another text {k}</p><p>Write to us</p></article>") for k in range(40)]
    pages += [(7000 + k, f"http://w/{k:02d}", version(k)) for k in range(12)]
    got = text_of(spark, *pages)
    assert all(got[100 * n + k] == f"The only line of story {k}" for n in (12, 6) for k in range(n))
    assert all(got[200 + k].count("\n") == 40 for k in range(2))
    assert all(got[5000 + k] == "\n".join([*story, f"Seen {k} times"]) for k in range(40))
    # the versions, as one page, are a partner of four of these
    assert all(got[6000 + k] == f"Another text {k}" + "\nWrite to us" * (k in (0, 1, 3, 7)) for k in range(40))
    assert all(got[7000 + k] == f"Seen {k} times" for k in range(12))


def test_attributes_and_names_do_not_drop_text(spark):
    pages = [
        "<article><p title=it's>one</p><p>two don't three</p></article>",
        "<article><h1 class='post-header header'>Title</h1><h2 id=\"Related-work\">Related</h2><div class=\"social-history\">History</div><section id=\"comments-on-method\">Method</section></article>",
        "<article><header><h1>Head</h1></header><p data-x='a>b' data-y=\"c>d\">body</p><a href=x/>link</a></article>",
        "<article><p>a < b</p><!--> shown <!-- <p>no</p> --><? no ?></ no><p hidden>no</p><div role=navigation>no</div><div itemtype=\"https://schema.org/Comment\">no</div><p>z</article>",
    ]
    got = text_of(spark, *[(k, f"http://h{k}/", p) for k, p in enumerate(pages)])
    assert got == {0: "one\ntwo don't three", 1: "Title\nRelated\nHistory\nMethod", 2: "Head\nbody\nlink", 3: "a < b\nshown\nz"}


def test_odd_pages(spark):
    pages = [(1, None, None), (2, "not a url", ""), (3, "http://h/x", "<"), (4, "http://h/y", "a < b <p"), (5, "http://h/z", "<nav class='ad'>never closed <article><p>kept</p></article>"), (None, "http://h/q", "<p>x</p>"), (6, "http://k/", "<main>" + "<p>w</p>" * 3000)]
    got = text_of(spark, *pages, pages[5])
    assert (got[1], got[2], got[4], got[5], got[None]) == ("", "", "a < b", "kept", "x")
    assert got[6] == "\n".join(["w"] * 3000)
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_page_columns(spark):
    df = spark.createDataFrame([(1, "http://h/", "<p>é x</p>", "t", 5)], PAGES + ", text string, n_chars int")
    assert html_text.main_text(df).first().asDict() == {"page_id": 1, "url": "http://h/", "text": "é x", "n_chars": 3}


def test_common_lines_are_longest():
    random.seed(3)

    for _ in range(500):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 12))] for _ in range(2))
        got = html_text.common_lines(a, b)
        rest = iter(b)
        assert len(got) == len(longest(a, b)) and got == sorted(set(got)) and all(a[k] in rest for k in got)


def test_pages_that_lost_their_article(spark):
    pages = {
        "<article><svg class='i'/><p>Hello</p></article>": "Hello",
        "<article><svg/><p>Hello</p><svg><text>no</text></svg> there</article>": "Hello\nthere",
        "<article><svg><svg></svg><text>inner</text></svg><p>x</p></article>": "x",
        "<article><svg data-x='</svg>'><text>no</text></svg><p>x</p></article>": "x",
        "<article><svg><p>broken icon</p></article>": "broken icon",
        "<form id='aspnetForm'><article><p>a</p><form>b</form></article><p>outside</p></form>": "a",
        "<fieldset><main><p>a</p></main></fieldset>": "a",
        "<form><div>all of the page</div></form>": "all of the page",
        "<form>search</form><p>all of the page</p>": "all of the page",
        "<header><main><p>a longer story stands here</p></main></header><p>short</p>": "a longer story stands here",
        "<p>a longer text than the teaser</p><aside><article>teaser</article></aside>": "a longer text than the teaser",
        "<article>story</article><nav><article>a teaser that is longer than the story</article></nav>": "story",
        "<p>Let <math><mi>x</mi><mspace/></math> be a number</p>": "Let x be a number",
        "<article>the story</article><div id='comments'><article>comment</article></div>": "the story",
        "<article><h1>t</h1>s</article><article>a comment that is longer</article>": "t\ns",
        "<article><p>the story itself</p><section><article>comment</article></section></article>": "the story itself",
        "<article><article><p>the only text</p></article></article>": "the only text",
        "<main><h1>Title</h1><article><p>text</p></article></main>": "Title\ntext",
        "<template><p>no</p><template>no</template>no</template><p>yes</p>": "yes",
        "one<br>two": "one\ntwo",
    }
    got = text_of(spark, *[(k, f"http://h{k}/", p) for k, p in enumerate(pages)])
    assert [got[k] for k in range(len(pages))] == list(pages.values())
