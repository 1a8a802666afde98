"""Ranked search against scoring of every document; packing; bounds; odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quietline.llm import search

TERM = re.compile("[^\x00-/:-@[-`{-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for key, text in items:
        hits = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if s > 0:
                hits.append((-s, math.inf if i is None else i))
        out += [(key, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(hits)[:k], 1)]
    return out


def found(spark, docs, items, k=20):
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = search.top(index, spark.createDataFrame(items, "item_id string, text string"), "item_id", k).collect()
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got]


ORDER = lambda r: (str(r[0]), r[1], r[3], r[2] is None, r[2] or 0)


@pytest.mark.parametrize(("seed", "segment"), [(0, 1 << 24), (1, 3000), (2, 500)])
def test_plain(spark, monkeypatch, seed, segment):
    monkeypatch.setattr(search, "SEGMENT_BYTES", segment)
    r = random.Random(seed)
    words = [f"W{int(r.paretovariate(0.7))}" for _ in range(300)] + ["É", "straße", "x"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", ",", "-"]) for _ in range(n))
    docs = [(i, text(r.choice([0, 3, 30, 200]))) for i in r.sample(range(10**6), 400)] + [(7_000_000 + i, "x straße") for i in range(30)]
    items = [(f"i{j}", text(r.choice([1, 5, 40]))) for j in range(25)] + [("same", "x x STRASSE straße"), ("none", "qqq"), ("empty", "")]
    assert sorted(found(spark, docs, items), key=ORDER) == sorted(plain(docs, items, 20), key=ORDER)
    monkeypatch.setattr(search, "QUERY_TERMS", 40)  # several searches
    assert sorted(found(spark, docs, items, 3), key=ORDER) == sorted(plain(docs, items, 3), key=ORDER)


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (3, None), (3, "alpha"), (3, "alpha"), (4, ""), (5, "... \n"), (6, "alpha " * 50_000)]
    items = [("a", "alpha"), ("a", "beta alpha"), (None, "beta"), ("n", None)]
    assert sorted(found(spark, docs, items), key=ORDER) == sorted(plain(docs, items, 20), key=ORDER)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_further_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "z", 4)], "doc_id int, text string, term string, segment int")
    items = spark.createDataFrame([("q", "a", 9, 2.5)], "item_id string, text string, rank int, score double")
    assert [r["doc_id"] for r in search.top(search.build(docs), items, "item_id").collect()] == [1]


def test_packing():
    """Every block gives back what went in, asked for alone or with others."""
    r = np.random.default_rng(1)
    sizes = [1, 2, 127, 128, 129, 1000, 1]
    docs = np.concatenate([np.sort(r.choice(60_000, n, replace=False)) for n in sizes])
    tfs = np.where(r.random(len(docs)) < 0.9, 1, r.integers(1, 70_000, len(docs)))
    lists = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    head, body, block, at = search.packed(docs, tfs, tfs, lists)
    for j, (a, n) in enumerate(zip(lists, sizes, strict=True)):
        p = search.Postings(head[block[j] : block[j + 1]].tobytes(), body[at[block[j]] : at[block[j + 1]]].tobytes())
        for some in ([len(p.head) - 1], range(len(p.head))):
            p.unpack(np.array(some))
            inside = np.repeat(p.open, np.diff(p.start))
            assert (p.docs[inside] == docs[a : a + n][inside]).all() and (p.tfs[inside] == tfs[a : a + n][inside]).all()


def test_blocks_stay_packed():
    """A threshold that only the rare term's documents reach leaves the frequent term's other blocks packed."""
    n = 20_000
    docs, rare = np.arange(n), np.arange(n - 30, n)
    both = np.concatenate([docs, rare])
    head, body, block, at = search.packed(both, np.ones(len(both), np.int64), np.full(len(both), 500_000), np.array([0, n]))
    common, few = (search.Postings(head[block[j] : block[j + 1]].tobytes(), body[at[block[j]] : at[block[j + 1]]].tobytes()) for j in (0, 1))
    got, _ = search.best([(1, common), (50, few)], np.full(n, 100), docs, 20, 0)
    assert sorted(got.tolist()) == rare[:20].tolist() and few.open.all()
    got, _ = search.best([(1, common), (50, few)], np.full(n, 100), docs, 20, 5_000_000)
    fresh = search.Postings(head[: block[1]].tobytes(), body[: at[block[1]]].tobytes())
    search.best([(1, fresh), (50, few)], np.full(n, 100), docs, 20, 5_000_000)
    assert sorted(got.tolist()) == rare[:20].tolist() and fresh.open.sum() <= 2
