"""The tree decides by counts and densities of a block and its neighbours, and a page takes linear time."""

import time

from quietline.llm import html


def features(tree):
    return {html.NUMBERS[tree[0]]} | features(tree[2]) | features(tree[3]) if isinstance(tree, tuple) else set()


def right(pages, tree):
    rows = html.rows_of(pages)
    return sum(html.keeps(tree, x) == bool(y) for x, y in rows) / len(rows)


def test_the_tree_reads_counts_and_densities_of_neighbours():
    used = features(html.fitted())
    assert {"words", "density"} <= used and used & {"words-1", "words+1"} and used & {"density-1", "density-2", "density+1", "density+2"}


def test_held_out_pages():
    tree = html.fitted()
    assert right(html.bare(99, 150), tree) > 0.98
    assert right(html.named(98, 150), tree) > 0.98
    assert right(html.told(), tree) == 1


def test_a_page_without_names():
    tree = html.fitted()
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    menu = "".join(f'<td><a href="/{k}">Item {k}</a></td>' for k in range(6))
    page = f"<table><tr>{menu}</tr></table><h1>A title here</h1><p>{words(60)}</p><p>And so.</p><p>{words(45)}</p><table><tr>{menu}</tr></table><p>2020 <a>Imprint</a> <a>Terms</a></p>"
    assert html.main_text(page, tree) == f"A title here\n\n{words(60)}\n\nAnd so.\n\n{words(45)}"


def test_linear_time():
    tree = html.fitted()
    for page in ("<div>" * 60_000 + "x", "<p>" * 60_000, "<p>" + "<b>" * 60_000 + "x", "<a" * 100_000, "<!" * 100_000, '<a b="' * 50_000, "<li>" * 60_000, "</p>" * 60_000, "<script>" + "<!--" * 50_000):
        t = time.time()
        html.main_text(page, tree)
        assert time.time() - t < 5, page[:8]


def test_odd_pages(spark):
    rows = [(1, None, "u", 3), (2, "", None, 3), (3, "<p>a", "u", None), (3, "<p>a", "u", None), (4, "plain words", "u", 1), (5, "<article>" + "w " * 50_000, "u", 1), (None, "&amp;\x00", "u", 1)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, n_chars int")
    got = sorted((r.page_id or 0, r.text[:12], r.n_chars) for r in html.extracted(pages).collect())
    assert got == [(0, "&\x00", 2), (1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1), (4, "plain words", 11), (5, "w w w w w w ", 99_999)]
    assert html.extracted(pages.where("page_id > 9")).count() == 0
