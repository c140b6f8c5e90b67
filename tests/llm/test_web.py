"""URL filters, main text and nearest neighbours."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import ann, urls, wrappers
from tests.llm.helpers import same_as_sql

PAGES = "page_id long, url string, html string"


def linked_pages():
    draw = random.Random(3)
    hosts = [f"h{i}.example.{t}" for i in range(8) for t in ("com", "net", "org")]
    rows = [(k, f"http://{draw.choice(hosts)}/{draw.choice(['en', 'de', 'fr', 'x'])}/{k}", "".join(f'<a href="//{draw.choice(hosts).upper()}/q">' for _ in range(draw.randint(0, 2)))) for k in range(150)]
    return [*rows, (1000, None, None), (1001, "nothing", "x"), (1002, "a://b", ""), (1002, "a://b", ""), (None, "http://NET/x?y", None), (1003, "x://u@A.b.NET:80?q/en/", "<a href='http://c.org'>")]


def test_urls_equal_sql(spark):
    rows = spark.createDataFrame(linked_pages(), PAGES)
    same_as_sql(urls.judged(rows), urls.ORACLE_SQL, pages=rows)
    assert urls.judged(spark.createDataFrame([], PAGES)).count() == 0


def test_rules(spark):
    cases = {
        "http://a.net/": "net/", "http://a.net": None, "http://example.net/en/x": "example.net/en/", "http://b.example.net/en/": "example.net/en/", "http://example.net/english": "net/", "http://notexample.com/de/": None,
        "http://example.com/de/1": "example.com/de/", "http://example.com/DE/": None, "https://X.ORG/fr/?a": "org/fr/", "http://org/fr/": "org/fr/", "ftp://a.net/en/#x": "net/", "http://a.b/http://c.net/": None,
    }
    rows = spark.createDataFrame([(k, u, "") for k, u in enumerate(cases)], PAGES)
    assert {r["page_id"]: r["rule"] for r in urls.judged(rows).collect()} == dict(enumerate(cases.values()))


def test_distrust_runs_against_links_and_trust_along_them(spark):
    rows = [(k, f"http://bad.example.com/de/{k}", "") for k in range(5)] + [(10, "http://farm.example.com/a", '<a href="http://bad.example.com/de/1">'), (11, "http://good.org/fr/1", '<a href="http://friend.example.com/">'), (12, "http://friend.example.com/a", "")]
    found = {r["host"]: r for r in urls.judged(spark.createDataFrame(rows, PAGES)).collect()}
    assert found["farm.example.com"]["distrust"] > 0 and found["farm.example.com"]["verdict"] == "block"
    assert found["friend.example.com"]["trust"] > 0 and found["friend.example.com"]["verdict"] == "allow"


SITE = """<!doctype html><html><head><title>{t}</title><script>var x = "<p>no</p>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>{t} nav</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content"><h1>{t}</h1><p>First &amp; best paragraph of {t}, with <b>bold</b>text and<br>a break.<p>Second one &eacute;\n   here {n}.<aside>Related: {n}</aside>
<form><input value="x"><label>Name</label></form><div class="ads">Buy {n}</div><ul><li>Point one {n}</li><li>Point two</li></ul><div class="comments"><p>Reader {n} says hello</p></div></div>
<div class="sidebar"><p>Latest {n}</p></div><footer>&copy; {t}</footer></body></html>"""


def test_wrapper_finds_the_main_text(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", SITE.format(t=f"Title {k}", n=k * 7)) for k in range(8)]
    found = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(8):
        assert found[k] == f"Title {k} First & best paragraph of Title {k}, with boldtext and a break. Second one é here {k * 7}. Point one {k * 7} Point two"


def test_wrapper_without_marks_drops_what_pages_share(spark):
    page = "<html><body><div><p>Welcome to our site</p></div><div><div><p>{a}</p><p>{b}</p></div></div><div><p>All rights reserved</p></div></body></html>"
    rows = [(k, "http://x.example/", page.format(a=f"Some long text number {k} " * 5, b=f"More of it {k * k}")) for k in range(5)]
    found = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(found[k] == " ".join((f"Some long text number {k} " * 5 + f"More of it {k * k}").split()) for k in range(5))


def test_wrapper_edges(spark):
    deep = "<div>" * 500 + "text" + "</div>" * 500
    rows = [(1, None, None), (2, "http://a/", ""), (3, "http://a/", "<p>one page"), (3, "http://a/", "<p>one page"), (4, "http://b/", "plain < text &am; &amp"), (5, None, "<article>no host</article>"), (6, "http://c/", "<article>" + "word " * 100_000 + "</article>"), (7, "http://d/", deep), (None, "http://e/", "<article>same</article>")]
    found = wrappers.extracted(spark.createDataFrame(rows, PAGES)).collect()
    by_id = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and by_id[1] == by_id[2] == "" and by_id[3] == "one page" and by_id[4] == "plain < text &am; &" and by_id[5] == "no host"
    assert len(by_id[6].split()) == 100_000 and by_id[7] == "text" and by_id[None] == "same"
    assert wrappers.extracted(spark.createDataFrame([], PAGES)).count() == 0


def texts_of(spark, pages):
    """page number to text, of pages of one host."""
    rows = [(k, "http://x.example/", html) for k, html in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, PAGES)).collect()}


def test_wrapper_takes_marked_text_at_every_place(spark):
    p = lambda k: f"<p>Text number {k} of this site, {k * k} words.</p>"
    t = lambda k: f"Text number {k} of this site, {k * k} words."
    pages = [f"<body class=home><article>{p(k)}</article></body>" for k in range(4)] + [f"<body class=single><article>{p(k)}</article></body>" for k in range(4, 6)]
    pages += [f"<main><article>{p(6)}</article></main>", f"<article>{p(7)}</article>", f"<article class=post>{p(8)}</article>", f"<article class=page>{p(9)}</article>"]
    pages += [f"<article>{p(10)}</article><div class=ad>Buy</div><article>{p(11)}</article>", f"<body class=plain><div>{p(12)}</div></body>"]
    found = texts_of(spark, pages)
    assert found == {**{k: t(k) for k in range(10)}, 10: f"{t(10)} {t(11)}", 11: t(12)}


def test_wrapper_keeps_what_follows_deep_nesting(spark):
    deep = lambda n, inner: "<div>" * n + inner + "</div>" * n
    page = "<div class=wrap><article><p>start {k}</p>{deep}<p>rest {k}</p></article></div><div class=comments>{comments}<p>late comment {k}</p></div>"
    inner = "<p>low {k}</p><nav>menu {k}</nav><aside>side <b>x</b></aside><form>field</form><p>lower {k}</p>"
    found = texts_of(spark, [page.format(k=k, deep=deep(70, inner.format(k=k)), comments=deep(70, "reply")) for k in range(4)])
    assert found == {k: f"start {k} low {k} lower {k} rest {k}" for k in range(4)}
    assert texts_of(spark, ["<article>" + "<b>" * 50_000 + "<p>x</b>" * 50_000 + "</article>end"])[0].startswith("x x")


def test_wrapper_drops_constants_and_keeps_varying_blocks_in_articles(spark):
    page = """<article><h1>Title {k}</h1><div class=hinweis><p>Same notice <b>everywhere</b></p></div><p>By <b>bold</b> of {k}.</p><h2 id=search>Search {k}</h2><section id=related-work><p>Work {k}</p></section>
    <div class=social-policy>Policy {k}</div><div class=related-posts><a href=/x>Post {k}</a></div><div class=kommentare>Kommentare sind zu</div><div class=comments-area><p>Reader {k}</p></div><p>{more}</p></article>"""
    found = texts_of(spark, [page.format(k=k, more=f"more {k} " * 20) for k in range(4)])
    assert found == {k: f"Title {k} By bold of {k}. Search {k} Work {k} Policy {k} " + " ".join([f"more {k}"] * 20) for k in range(4)}
    copies = texts_of(spark, [f"<title>{k}</title><article><h1>{k}</h1><p>One text that all have</p></article>" for k in range(3)])
    assert copies == {k: f"{k} One text that all have" for k in range(3)}


def test_wrapper_of_the_host_decides_on_a_marked_page(spark):
    """One page on two hosts: what all pages of a host have is its template there, and text on the other."""
    page = "<article><h1>{t}</h1><div class=letter><p>Write to us for news</p></div><p>{t} is what this one is about, at some length.</p></article>"
    same = page.format(t="Harbour")
    rows = [(0, "http://a.example/0", same), (100, "http://b.example/0", same)]
    rows += [(k, f"http://a.example/{k}", page.format(t=f"Title {k}")) for k in range(1, 5)]
    rows += [(100 + k, f"http://b.example/{k}", f"<article><h1>Other {k}</h1><p>Only of page {k}</p><p>And number {k * k} is what it says.</p></article>") for k in range(1, 5)]
    found = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[0] == "Harbour Harbour is what this one is about, at some length."
    assert found[100] == "Harbour Write to us for news Harbour is what this one is about, at some length."


def test_alignment_by_brute_force():
    """Simple tree matching against all order-preserving alignments of children."""
    import itertools

    draw = random.Random(8)

    def tree(depth):
        return [draw.choice("ab"), 1, 0, 0, 0, 0, [tree(depth - 1) for _ in range(draw.randrange(4))] if depth else []]

    def best(a, b):
        if a[0] != b[0]:
            return 0
        x, y = a[6], b[6]
        some = lambda n, m: itertools.combinations(range(n), m)
        return 1 + max(sum(best(x[i], y[j]) for i, j in zip(p, q, strict=True)) for m in range(min(len(x), len(y)) + 1) for p in some(len(x), m) for q in some(len(y), m))

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert wrappers._match(a, b)[0] == best(a, b) == wrappers._match(b, a)[0]


def test_simple_tree_matching():
    tree = lambda kind, *c: [kind, 1, 0, 0, 0, 0, list(c)]
    a = tree("a", tree("b"), tree("c", tree("d")), tree("e"))
    b = tree("a", tree("c", tree("d"), tree("x")), tree("b"), tree("e"))
    assert wrappers._match(a, b)[0] == 4 and wrappers._match(a, tree("z"))[0] == 0
    merged = wrappers.merge(a, b)
    assert [c[0] for c in merged[6]] == ["b", "c", "b", "e"] and merged[1] == 2


def vectors(n, d=16, seed=0, spread=1.0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d))
    return x * (1 + spread * draw.random((n, 1)))


def exact_lists(x, ids, asked, k=20):
    out = {}
    for i in np.flatnonzero(asked):
        scores = [math.fsum((x[i] * x[j]).tolist()) for j in range(len(x))]
        order = sorted((j for j in range(len(x)) if ids[j] != ids[i]), key=lambda j: (-round(scores[j], 10), ids[j]))
        out[int(ids[i])] = [int(ids[j]) for j in order[:k]]
    return out


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def test_recall(spark):
    x, ids = vectors(3000).astype(np.float32).astype(float), np.arange(3000)
    found = ann.search(frame(spark, x, ids), F.col("id") % 20 == 0).toPandas()
    expected = exact_lists(x, ids, ids % 20 == 0)
    ours = found.sort_values(["query_id", "rank"]).groupby("query_id")["vec_id"].apply(list)
    assert set(ours.index) == set(expected) and (ours.map(len) == 20).all()
    assert np.mean([len(set(ours[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9


@pytest.mark.parametrize("n", [60, 400, 1500])
def test_recall_of_small_tables(spark, n):
    """No size has a way of its own: small tables are pruned as large ones are."""
    x, ids = vectors(n, seed=n).astype(np.float32).astype(float), np.arange(n)
    found = ann.search(frame(spark, x, ids), F.col("id") % 20 == 0).toPandas()
    expected = exact_lists(x, ids, ids % 20 == 0)
    ours = found.sort_values(["query_id", "rank"]).groupby("query_id")["vec_id"].apply(list)
    assert (ours.map(len) == 20).all() and np.mean([len(set(ours[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9


def test_shards_stream_their_queries(spark, monkeypatch):
    """Rows and queries of a shard come in many batches; all buckets visited, the lists are exact."""
    x, ids = vectors(700, seed=5).astype(np.float32).astype(float), np.arange(700)
    monkeypatch.setattr(ann, "SHARD", 90)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = ann.search(frame(spark, x, ids), F.col("id") % 7 == 0, aim=1.0).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    ours = found.sort_values(["query_id", "rank"]).groupby("query_id")["vec_id"].apply(list).to_dict()
    assert ours == exact_lists(x, ids, ids % 7 == 0)


def test_ties_and_copies(spark, monkeypatch):
    x = np.vstack([np.tile(vectors(1), (300, 1)), vectors(50, seed=1)]).astype(np.float32).astype(float)
    ids = np.arange(350)
    monkeypatch.setattr(ann, "SHARD", 40)
    found = ann.search(frame(spark, x, ids), F.col("id") % 20 == 0, aim=1.0).toPandas()
    ours = found.sort_values(["query_id", "rank"]).groupby("query_id")["vec_id"].apply(list).to_dict()
    assert ours == exact_lists(x, ids, ids % 20 == 0)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (20, [3.0, 3.0]), (20, [1.0, 0.0]), (40, [])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 0] == [(1, 20, 9.0), (2, 1, 4.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_shards_hold_every_bucket_once(size):
    counts = np.random.default_rng(0).integers(0, 30, (3, 50))
    packed = ann.Shards.pack(counts, size)
    held: dict[int, int] = {}
    for t in range(3):
        for b in range(50):
            for k in range(packed.parts[t, b]):
                held[(t, packed.first[t, b] + k)] = held.get((t, packed.first[t, b] + k), 0) + -(-int(counts[t, b]) // int(packed.parts[t, b]))
    assert max(held.values()) <= max(size, 1) and len({s for _, s in held}) == len(held)
