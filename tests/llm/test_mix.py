"""The mix's draws are hypergeometric at every size, and any column names do."""

import math
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quietline.llm import mix


def draws(spark, quota, left, right, n):
    whole = lambda v: F.lit(v).cast("long")
    drawn = mix.hypergeometric(F.xxhash64("id"), whole(quota), whole(left), whole(right))
    return [r[0] for r in spark.range(n).repartition(8).select(drawn).collect()]


@pytest.mark.parametrize("quota, left, right", [(5, 6, 9), (40, 30, 50), (1, 1, 1), (3, 100, 4)])
def test_draws_have_their_chances(spark, quota, left, right):
    n, free, chi = 8000, -1, 0.0
    seen = Counter(draws(spark, quota, left, right, n))
    assert min(seen) >= max(0, quota - right) and max(seen) <= min(quota, left)
    for x in range(max(0, quota - right), min(quota, left) + 1):
        want = n * math.comb(left, x) * math.comb(right, quota - x) / math.comb(left + right, quota)
        if want > 5:
            chi, free = chi + (seen[x] - want) ** 2 / want, free + 1
    assert chi < free + 4.5 * math.sqrt(2 * free + 1) + 4


@pytest.mark.parametrize("quota, left, right", [(4_000_000, 8_000_000, 8_000_000), (10**13, 16 * 10**12, 10**9)])
def test_large_draws_have_their_moments_and_no_steps(spark, quota, left, right):
    got, n = draws(spark, quota, left, right, 8000), left + right
    sd = math.sqrt(quota * (left / n) * (right / n) * ((n - quota) / (n - 1)))
    z = [(x - quota * left / n) / sd for x in got]
    assert abs(statistics.mean(z)) < 0.05 and abs(statistics.pstdev(z) - 1) < 0.04
    assert abs(statistics.mean(v**4 for v in z) - 3) < 0.4
    assert len({x % 64 for x in got}) == 64


def test_split_is_exact(spark):
    words = [[(s, k, 0 if (k * 7 + i) % 5 == 0 else (k * 37 + i * 11) % 90) for k in range(1 << 10)] for i, s in enumerate(("a", None))]
    leaves = spark.createDataFrame([r for rows in words for r in rows if r[2]], "source string, shard long, words long")
    roots = spark.createDataFrame([("a", 20_000), (None, 1)], "source string, quota long")
    rows = mix.split(leaves, roots, 10, 3).collect()
    most = {(s, k): w for rows_ in words for s, k, w in rows_}
    assert all(0 < r.quota <= most[r.source, r.shard] for r in rows)
    total = Counter()
    for r in rows:
        total[r.source] += r.quota
    assert total == {"a": 20_000, None: 1}


def test_columns_with_names_of_its_own(spark):
    rows = [(k % 7 or None, " ".join(f"w{i}" for i in range(k)), f"s{k % 3}", k, 1, "x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, draws int, _size int, copies string")
    mixed = mix.mixed(docs)
    assert mixed.columns == docs.columns
    planned = mix.taken(mix.plan(docs)).agg(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in mixed.collect()) == planned
    assert {r.draws for r in mixed.collect()} <= set(range(40))
