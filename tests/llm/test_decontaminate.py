"""Windows of a benchmark in documents, against brute force; bounds of blocks; items without a name."""

import random

from quietline.llm import decontaminate as d


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = d.words_in(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, named = d.words_in(t), set(), set()
        for x, of in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    named |= {str(n) for n in of if n is not None}
        out.append((str(i), len(w), len(hit), tuple(sorted(named))))
    return sorted(out)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)


def got(found):
    rows = found.withColumn("n", d.hit_words(d.F.col("spans"))).collect()
    return sorted((str(r.doc_id), r.n_words, r.n, tuple(r["items"])) for r in rows)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    say = lambda n: rnd.choice([" ", ", ", " -- "]).join(rnd.choice(["a", "B", "c1", "é", "Dd", "x y"]) for _ in range(n))
    items = [(k, say(rnd.choice([1, 3, 5, 7, 12]))) for k in range(30)] + [(None, "only here now then"), (31, None), (32, " ,"), (1, say(9)), (2, "zz")]
    docs = [(k, say(rnd.randrange(40))) for k in range(60)] + [(None, "it is ONLY here now, then"), (5, None), (5, ""), (61, "zz " * 3000), (61, items[0][1])]
    want = brute(docs, items, 5)
    for block in (100_000, 7):
        assert got(d.find(*tables(spark, docs, items), size=5, block_windows=block)) == want
    kept = d.clean(*tables(spark, docs, items), size=5)
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(not n for _, _, n, _ in want)


def test_a_window_that_all_items_share(spark):
    shared = " ".join(f"s{k}" for k in range(10))
    items = [(k, f"{shared} own{k}") for k in range(400)]
    docs = [(k, f"x {shared} y{k}") for k in range(50)] + [(99, "clean " * 20)]
    rows = d.find(*tables(spark, docs, items), block_windows=100).collect()
    assert {(r.doc_id == 99, len(r["items"])) for r in rows} == {(False, 400), (True, 0)}


def test_clashing_columns_and_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b c"), (2, "d")], [(7, "B c")])
    extra = docs.selectExpr("doc_id", "text", "'q' AS row", "1 AS windows", "2 AS spans", "'u' AS doc")
    found = d.find(extra, items)
    assert found.columns == ["doc_id", "text", "row", "windows", "doc", "n_words", "spans", "items"]
    assert {(r.doc_id, r.row, tuple(r["items"])) for r in found.collect()} == {(1, "q", ("7",)), (2, "q", ())}
    assert d.find(docs.where("doc_id < 0"), items).count() == 0
    assert {r.n_words for r in d.find(docs, items.where("item_id < 0")).collect()} == {3, 1}
    assert d.clean(extra, items).columns == extra.columns


def test_one_block_at_a_time(spark, monkeypatch):
    """However many blocks a benchmark has, one is sent at a time, and results don't change."""
    docs = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(40))) for i in range(30)]
    items = [(j, " ".join(f"w{(j * 5 + k) % 90}" for k in range(15))) for j in range(20)]
    want = sorted(map(str, d.find(*tables(spark, docs, items)).collect()))
    live, most, context = set(), [0], spark.sparkContext
    send = type(context).broadcast

    def broadcast(self, value):
        b = send(self, value)
        if not isinstance(value, d.Index):
            return b
        live.add(id(b))
        most[0] = max(most[0], len(live))
        destroy = b.destroy
        b.destroy = lambda *a, **k: (live.discard(id(b)), destroy(*a, **k))
        return b

    monkeypatch.setattr(type(context), "broadcast", broadcast)
    sent = d.find(*tables(spark, docs, items), block_windows=20)
    assert sorted(map(str, sent.collect())) == want and most[0] == 1
