"""Differencing of pages: alignment, neighbours over ranges, ties that markup breaks, and broken markup."""

from __future__ import annotations

import random
import time

import pytest

from codemass.llm import htmltext

SCHEMA = "page_id long, url string, html string"


def brute_length(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("limit", [1, 32 << 20])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, limit):
    monkeypatch.setattr(htmltext, "_ALIGN_BYTES", limit)
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice("abcdef"[: rnd.randint(1, 6)]) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        found = htmltext.aligned(a, b)
        pairs = sorted(found.items())
        assert all(a[i] == b[j] for i, j in pairs) and [j for _, j in pairs] == sorted({j for _, j in pairs})
        assert len(pairs) == brute_length(a, b)


def test_many_equal_lines_align_fast():
    began = time.time()
    assert len(htmltext.aligned(["x", "y"] * 10_000, ["x"] * 15_000)) == 10_000
    assert time.time() - began < 5


@pytest.mark.parametrize("page", ['<a "' * 250_000 + "'>'", "<a '" + "<a " * 300_000 + ">'", '"' * 1_000_000, "<a " + '"' * 1_000_001, "<!" * 400_000,
        "<!--" * 200_000,
    "<div>" * 200_000 + "</p>" * 200_000, "</script" * 100_000, "<script>" + "</script" * 100_000, "<p a='" * 150_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    htmltext.blocks(page)
    assert time.time() - began < 6


def test_tags_with_quotes():
    read = lambda s: [t for _, t in htmltext.blocks(s)]
    assert read("<p title='a>b'>x</p><p title=\"it's\">y<p c=d'>z") == ["x", "y", "z"]
    assert read("a < b <1> <p") == ["a < b <1> <p"] and read("x<!-- <p> -->y<!doctype html>z<?xml?>") == ["xyz"]
    assert read("<script>if (a<b) '</p>'</SCRIPT >k<style>q") == ["k"] and read("<br/>a<br>b<hr/>c") == ["a b", "c"]


def plain_pages(n: int = 8) -> list[tuple]:
    return [(i, f"http://h.org/p/{i}", f"<div>Shared heading</div><p>own {i} text</p><div>More of the site</div>") for i in range(n)]


def test_text_does_not_depend_on_ranges(spark):
    rnd = random.Random(8)
    lines = [f"line {i} of sites" for i in range(12)]
    rows = plain_pages()
    for i in range(100, 220):
        body = "".join(f"<p>{x}</p>" for x in rnd.sample(lines, 4)) + f"<p>own {i}</p>"
        rows.append((i, rnd.choice([f"http://s{i % 3}.org/{i % 7}/{i}", "http://hot.org/same", "http://hot.org/sane", None, "x"]),
                rnd.choice(["{}", "<main>{}</main>", "<main>{}</main><p>out</p>"]).format(body)))
    rows += rows[20:26]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = [sorted((r["page_id"], r["url"] or "", r["text"]) for r in htmltext.extract(pages.repartition(p), ranges=n).collect()) for p,
        n in ((1, 1), (3, 4), (5, 64), (2, 150))]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == len(rows)
    # by differencing alone: without it the heading and the line of the site would stay
    assert [t for k, _, t in got[0] if k < 8] == [f"own {i} text" for i in range(8)]
    # the neighbours, found by brute force; the print that orders pages of one URL is not needed where URLs differ
    single = sorted((u.replace("http://", "").split("/")[0], u, k, h) for k, u, h in rows if u and u.startswith("http://s") or k < 8)
    want = {}
    for at, (host, u, k, h) in enumerate(single):
        near = [single[x] for x in (at - 1, at + 1) if 0 <= x < len(single) and single[x][0] == host and single[x][1] != u]
        nearest = max(near, key=lambda x: htmltext._common(x[1], u)) if near else None
        want[k] = htmltext.main_text(htmltext.blocks(h), nearest and htmltext.blocks(nearest[3]))
    seen = [k for _, _, k, _ in single]
    assert {k: t for k, _, t in got[0] if k in want and seen.count(k) == 1} == {k: t for k, t in want.items() if seen.count(k) == 1}


def test_markup_breaks_ties():
    page = htmltext.blocks("<p>a</p><main><p>b</p><p>c</p><p>d</p></main><nav>n</nav>")
    assert htmltext.main_text(page, None) == "b\n\nc\n\nd"
    assert htmltext.main_text(page, htmltext.blocks("<main><p>b</p><p>x</p></main><p>d</p>")) == "b\n\nc"  # d is outside the neighbour's content
    assert htmltext.main_text(page, htmltext.blocks("<p>b</p><p>c</p>")) == "b\n\nc\n\nd"  # the neighbour says nothing
    bare = htmltext.blocks("<p>a</p><p>b</p><p>c</p>")
    assert htmltext.main_text(bare, htmltext.blocks("<p>a</p><main><p>b</p></main>")) == "b\n\nc"
    assert htmltext.main_text(bare, bare) == "a\n\nb\n\nc"


def test_nulls_clashes_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, None, None, "r", "u"), (None, None, None, "r", "u"),
            (1, "http://a/b", "<p>" + "x" * 300_000 + "</p>", None, None)], SCHEMA + ", _range string, _URL string")
    rows = htmltext.extract(pages, ranges=3).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, 300_000] and {r["_range"] for r in rows} == {"r", None}
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_names_are_furniture_only_as_a_whole(spark):
    kept = ['<h2 id="comments">Comments on design</h2>', '<h2 id="related-work">Related work</h2>', '<section class="promo-code"><p>How codes work</p></section>',
        '<section id="comments-on-design"><p>Designs</p></section>', '<p id="notice">A word of notice</p>', '<div class="notice-period"><p>Two months</p></div>',
        '<div class="main-content"><p>Body text</p></div>', '<p class="social-science">Science</p>', '<div class="cookie-recipe"><p>Flour</p></div>']
    gone = ['<div class="comments">a1</div>', '<div id="related-posts">a2</div>', '<ul class="share-buttons">a3</ul>', '<div class="x ad-slot-2">a4</div>',
        '<section id="newsletter_signup">a5</section>', '<div class="Cookie-Consent-Banner">a6</div>', '<div class="advertisement">a7</div>',
        '<div class="side-bar">a8</div>', '<div class="sponsored-content">a9</div>']
    page = f"<html><body><article>{''.join(x for pair in zip(kept, gone) for x in pair)}</article></body></html>"
    pages = spark.createDataFrame([(1, "https://a.org/x", page)], SCHEMA)
    want = ["Comments on design", "Related work", "How codes work", "Designs", "A word of notice", "Two months", "Body text", "Science", "Flour"]
    assert htmltext.extract(pages).first()["text"].split("\n\n") == want
