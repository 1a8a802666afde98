"""Resharding: least flow against every flow, sizes, files that stay, odd rows."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quietline.llm import sharding


def every_flow(supply, demand):
    """All whole flows of a small case."""
    if not supply:
        yield {} if not any(demand) else None
        return

    def ways(left, open_):
        if len(open_) == 1:
            if left <= open_[0]:
                yield (left,)
            return
        for x in range(min(left, open_[0]) + 1):
            for rest in ways(left - x, open_[1:]):
                yield (x, *rest)

    for row in ways(supply[0], demand):
        for rest in every_flow(supply[1:], [d - x for d, x in zip(demand, row, strict=True)]):
            if rest is not None:
                yield {(len(supply), j): x for j, x in enumerate(row)} | rest


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_flow(seed):
    r = random.Random(seed)
    n, m = r.choice([(2, 3), (3, 2), (3, 3)])
    supply = [r.randrange(5) for _ in range(n)]
    demand = sharding.even(sum(supply), m)
    price = [[r.randrange(6) for _ in range(m)] for _ in range(n)]
    got = sharding.cheapest_flow(supply, demand, lambda i, j: price[i][j])
    assert [sum(v for (i, _), v in got.items() if i == k) for k in range(n)] == supply
    assert [sum(v for (_, j), v in got.items() if j == k) for k in range(m)] == demand
    least = min(sum(price[n - left][j] * x for (left, j), x in f.items()) for f in every_flow(supply, demand))
    assert sum(price[i][j] * v for (i, j), v in got.items()) == least


def test_sums_must_agree():
    with pytest.raises(ValueError, match="differ"):
        sharding.cheapest_flow([1], [2], lambda i, j: 0)


def rows(seed, n=3000):
    r = random.Random(seed)
    out = [(i, "é" * int(r.paretovariate(0.9) % 300), r.choice("aaaabcdefgh")) for i in range(n)]
    return out + [(None, None, None)] * 500 + [(5, "same text", "a")] * 1500 + [(9, "", None)]


SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("law", ["bytes", "rows"])
@pytest.mark.parametrize("shards", [16, 5])
def test_whole(spark, law, shards):
    data = rows(1)
    store = sharding.laid_out(spark.createDataFrame(data, SCHEMA).repartition(4), 12)
    new = sharding.resharded(store, shards, law)
    got = sharding.digest(new).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, size(t), zlib.crc32((t or "").encode())) for i, t, _ in data)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(shards))
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    weights = [sum(r["size"] if law == "bytes" else 1 for r in own) for own in by.values()]
    assert max(weights) - min(weights) <= (1 if law == "rows" else 0.05 * sum(weights) / shards)
    assert {r["law"] for r in got} == {law} and {r["grown_shard"] for r in got} == {None}
    # What moved is what didn't fit, to a document or so a shard.
    weight = "size" if law == "bytes" else "one"
    old = {r["shard"]: r["n"] for r in store.groupBy("shard").agg(F.sum(weight).alias("n")).collect()}
    capacity = sharding.even(sum(old.values()), shards)
    least = sum(max(0, n - (capacity[s] if s < shards else 0)) for s, n in old.items())
    moved = store.select("hash", "shard", weight).join(new.select("hash", F.col("shard").alias("to")), "hash").where("shard <> to").agg(F.sum(weight)).first()[0]
    assert least <= moved <= 1.05 * least


def test_files_stay(spark):
    data = [(i, "x" * 100, "a" if i % 2 else "b") for i in range(4000)]
    store = sharding.laid_out(spark.createDataFrame(data, SCHEMA), 12)
    first = sharding.resharded(store, 3)
    again = sharding.resharded(first, 3)
    assert sorted(again.inputFiles()) == sorted(first.inputFiles())  # balanced already
    assert set(store.inputFiles()) & set(sharding.resharded(store, 12).inputFiles())  # heads of shards stay


def test_cost(spark):
    """A price for each way is followed: shard 0 is cheap to reach from 1 only."""
    flow = sharding.cheapest_flow([0, 8, 4], [4, 4, 4], lambda i, j: 0 if i == j else (1 if (i, j) == (1, 0) else 9))
    assert flow == {(1, 0): 4, (1, 1): 4, (2, 2): 4}


def test_odd_rows(spark):
    empty = sharding.laid_out(spark.createDataFrame([], SCHEMA), 12)
    assert sharding.digest(sharding.resharded(empty, 16)).collect() == []
    one = sharding.laid_out(spark.createDataFrame([(1, "y" * 1_000_000, None)], SCHEMA), 12)
    assert [r["slot"] for r in sharding.digest(sharding.resharded(one, 16)).collect()] == [0]
    names = "doc_id long, text string, source string, shard string, size string, class string, hash string, doc string, law string, slot string"
    clash = spark.createDataFrame([(i, "t", "s", *"abcdefg") for i in range(40)], names)
    got = sharding.resharded(sharding.laid_out(clash, 2), 4, "rows")
    assert got.select("doc.*").columns == clash.columns and got.count() == 40 and sharding.digest(got).count() == 40


def test_unknown_law(spark):
    with pytest.raises(ValueError, match="law"):
        sharding.resharded(spark.range(1), 2, "luck")


def test_even():
    assert all(max(e) - min(e) <= 1 and sum(e) == t for t, e in ((t, sharding.even(t, 7)) for t in itertools.chain(range(20), [10**15])))


def test_resharded_again(spark):
    """A store of kept and new files is resharded like any other, and no row is lost."""
    data = [(i, "x" * (i % 300), "abc"[i % 3]) for i in range(3000)]
    first = sharding.resharded(sharding.laid_out(spark.createDataFrame(data, SCHEMA), 12), 6)
    again = sharding.digest(sharding.resharded(first, 9, "rows")).collect()
    assert sorted(r["doc_id"] for r in again) == list(range(3000))
    assert {r["shard"] for r in again} == set(range(9)) and {r["law"] for r in again} == {"rows"}
