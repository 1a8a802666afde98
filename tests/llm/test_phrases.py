"""Phrases by pattern growth against plain counting; odd rows."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quietline.llm import phrases

LEAST, SHARE = 3, 80


def plain(rows, least, most):
    """The definition, word for word."""
    by_lang = {}
    for text, lang in rows:
        f = by_lang.setdefault("und" if lang is None else lang, Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = tuple(re.findall("[^ \t]+", piece))
            f.update(w[i : i + k] for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in by_lang.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= SHARE * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, r = min((Fraction(2_000_000 * a, f[p[:k]] + f[p[k:]]).__floor__(), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, i, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def mined(spark, rows, least=LEAST, most=2000, schema="text string, lang string"):
    return sorted(tuple(r) for r in phrases.mined(spark.createDataFrame(rows, schema), least, most).collect())


@pytest.mark.parametrize("seed", range(4))
def test_plain(spark, seed):
    r = random.Random(seed)
    words = ["a", "B", "b", "é", "ÉÉ", "x-y", "'", "the", "the"]
    gaps = [" ", " ", " ", "\t ", ", ", ".", "\n", "!? "]
    rows = [("".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(40))), r.choice(["en", "de", "und", None])) for _ in range(80)]
    assert mined(spark, rows) == plain(rows, LEAST, 2000)
    assert mined(spark, rows, most=7) == plain(rows, LEAST, 7)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" \t", "en"), ("...", None), ("a b c d e", "xx")]
    assert mined(spark, rows) == []
    assert mined(spark, []) == []
    twice = [("one two", "en")] * 5 + [("one two three " * 4000, None)]
    assert mined(spark, twice) == plain(twice, LEAST, 2000)


def test_further_columns(spark):
    rows = [("one two", "en", 1, "x")] * 4
    got = phrases.mined(spark.createDataFrame(rows, "text string, lang string, k1 int, phrase string"), 2).collect()
    assert [(r["phrase"], r["a"]) for r in got] == [("one two", 4)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_grow_in_batches(monkeypatch, size):
    """A prefix that goes over batches, and one too large to hold, are grown alike."""
    r = np.random.default_rng(5)
    x = np.unique(np.concatenate([r.integers(1, 3, (400, 2)), r.integers(0, 6, (400, 2))], axis=1), axis=0)
    x[x[:, 2] == 0, 3] = 0
    x = np.unique(x, axis=0)
    n = r.integers(1, 9, len(x))
    want = Counter()
    for row, c in zip(x.tolist(), n.tolist(), strict=True):
        for k in (2, 3, 4):
            if row[k - 1]:
                want[(*row[:k], *[0] * (4 - k))] += c
    want = sorted((*p, a) for p, a in want.items() if a >= 6)
    names = [*phrases.CONTEXT, "n"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in [*x[i : i + size].T, n[i : i + size]]], names) for i in range(0, len(x), size)]
    for held in (phrases.HELD, 32):
        monkeypatch.setattr(phrases, "HELD", held)
        got = [tuple(v.values()) for b in phrases.grow(iter(batches), 6) for v in b.to_pylist()]
        assert sorted(got) == want


def test_contexts_go_on(spark):
    """Pairs are counted once: no context of two words alone leaves the tasks, and those that do hold every longer phrase."""
    rows = [("a b, a b c. a b c d e! b c", "en")] * 3 + [("x y", "en"), ("z", "en"), ("", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").select("text", phrases.F.lit(7).cast("long").alias("lang_key"))
    every = spark.sparkContext.broadcast(np.full(1 << (phrases.BITS - 3), 255, np.uint8))
    got = phrases.projected(docs, every, every).collect()
    assert all(r["k3"] for r in got)
    assert sorted((sum(r[c] != 0 for c in phrases.CONTEXT), r["n"]) for r in got) == [(3, 3), (3, 3), (4, 3), (4, 3)]
    pairs = phrases.frequent_pairs(docs, every, 3)
    assert sorted(r["a"] for r in pairs.collect()) == [3, 3, 9, 9]
    assert mined(spark, rows) == plain(rows, LEAST, 2000)
