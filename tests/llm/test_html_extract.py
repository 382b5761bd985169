import itertools
import re
import time

import numpy as np
import pytest

from evigraph.llm import html_extract as H


def text_of(page):
    return H.extract([page], H.trained(), {})[0]


def test_article_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site name</h1><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav></header>
    <div class="cookie-notice">We use cookies to make this site work for you.</div><aside class="sidebar"><h3>Related</h3><ul><li><a href="#">Other story</a></li></ul></aside>
    <article><h1>A title  with&nbsp;space</h1><p>First   paragraph with <b>bold</b> words,
    and &lt;more&gt; of them to read.</p><div class="ad">Buy this now, it is cheap.</div><p>Second paragraph, which is also a sentence.<br>With a line.</article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this story a lot, thank you.</p></div></section>
    <form action="/s"><label>Search</label><input name=q><button>Go</button></form><footer>&copy; 2020 Somebody</footer></body></html>"""
    assert text_of(page) == "A title with space\nFirst paragraph with bold words, and <more> of them to read.\nSecond paragraph, which is also a sentence. With a line."


@pytest.mark.parametrize("page", ["", "   ", "<", "<<<>>>", "<p", "<!-- open", "<script>never closed", "</p></div>", "<p class='x>a</p>", "plain text &amp; more", "<a" * 2000, "<div>" * 300 + "x"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(text_of(page), str)


def test_decoding_is_the_best_consistent_choice():
    r = np.random.default_rng(2)
    for _ in range(60):
        page = H.Page()
        for _ in range(int(r.integers(1, 8))):
            page.add("div", int(r.integers(0, len(page.tag))), "")
        logit = r.normal(0, 2, len(page.tag))
        value = lambda c: sum(-np.logaddexp(0, -z) if x else -np.logaddexp(0, z) for x, z in zip(c, logit))
        fine = [c for c in itertools.product((True, False), repeat=len(page.tag)) if c[0] and all(not c[v] or c[page.parent[v]] for v in range(1, len(c)))]
        assert value(H.decode(page, logit)) == pytest.approx(max(map(value, fine)))


def test_unseen_pages_of_the_generator():
    right = total = 0
    for page, _ in H.training_pages(150, seed=77):
        chosen = H.decode(page, H.trained().logit(H.features(page, {})))
        for v, text in page.segments:
            total += 1
            right += chosen[v] == (H._MARK in text)
    assert right / total > 0.97


def test_query_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r["page_id"]: r for r in H.extract_text(pages).collect()}
    assert len(rows) == pages.count()
    same = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        tree = H.parse(inner)
        want = "\n".join(t for _, t in tree.segments)
        same += rows[r["page_id"]]["text"] == want
        assert rows[r["page_id"]]["n_chars"] == len(rows[r["page_id"]]["text"])
    assert same >= 0.95 * len(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "old", 5), (2, "", "old", None), (2, "", "old", None), (None, "<p>" + "word " * 50_000 + "</p>", None, 1)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long")
    out = H.extract_text(df).collect()
    assert sorted(r["n_chars"] for r in out)[:3] == [0, 0, 0] and len(out) == 4
    assert H.extract_text(df.limit(0)).count() == 0


def blocks(markup):
    return [t for _, t in H.parse(markup).segments]


@pytest.mark.parametrize(
    "markup, want",
    [
        ("<article><p>before</p><svg>x<p>after</p></article>", ["before", "x", "after"]),
        ("<p>E = <math><mi>m</mi></math> end</p>", ["E = m end"]),
        ('<p>a<script src="x.js"/>alert(1)</script>b</p>', ["ab"]),
        ('<p>a<svg><title>t</title><path d="M0>"/></svg>b</p>', ["ab"]),
        ("<p>one<canvas>two</canvas> <noscript>three</noscript><p>four<template>", ["onetwo three", "four"]),
        ('<p title="a>b">c', ["c"]),
        ("<style>p>a{}</style >x", ["x"]),
    ],
)
def test_nothing_but_scripts_and_drawings_is_lost(markup, want):
    assert blocks(markup) == want


@pytest.mark.parametrize(
    "make", [lambda n: "<a" * n, lambda n: '<a "x>' * n, lambda n: "<div>" * n + "</nav>" * n, lambda n: "<svg>" * n, lambda n: "<svg><p>" * n + "</svg>", lambda n: "<li><div>" + "<blockquote>" * n + "</li>" * n, lambda n: "<p x='" * n + ">"]
)
def test_time_is_linear_in_the_page(make):
    took = []
    for n in (50_000, 100_000):
        page, began = make(n), time.process_time()
        H.parse(page)
        took.append(time.process_time() - began)
    assert took[1] < 0.2 + 4 * took[0] and took[1] < 10


def test_main_text_of_written_pages():
    """Main text by itself: what the writer marked, read off its page without the parser."""
    import html
    import random

    r, same = random.Random(123), 0
    for _ in range(120):
        raw = H._Writer(r).page()
        words = re.sub(r"<[^>]*>", " ", re.sub(r"</?[abi](?: [^>]*)?>", "", re.sub(r"<style.*?</style>|<title>.*?</title>|<!--.*?-->", " ", raw, flags=re.DOTALL)))
        want = [w[1:] for w in html.unescape(words).split() if w.startswith(H._MARK)]
        got = text_of(raw.replace(H._MARK, "")).split()
        same += got == want
    assert same >= 95
