"""Small cases with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietline.operators import geo, identity, rules, scores, timeline
from quietline.sources import tables


def test_benjamini_hochberg(spark):
    q = scores.adjusted(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double"), "p").collect()
    assert {r.i: round(r.q, 9) for r in q} == {1: 0.03, 2: 0.04, 3: 0.04}


def test_states_at_the_border(spark):
    x = spark.createDataFrame([(599,), (600,), (None,), (-1,)], "a int").select(rules.device_state(F.col("a")).alias("s"))
    assert [r.s for r in x.collect()] == ["UP", "DOWN", "UNKNOWN", "UNKNOWN"]


def test_one_to_one_drops_shared_ends(spark):
    x = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), ("d", 4), (None, 5)], "l string, r int")
    assert [tuple(r) for r in identity.one_to_one(x, "l", "r").collect()] == [("a", 1)]


def test_anchored_groups_are_not_chains(spark):
    x = spark.createDataFrame([("k", f"2024-01-01 00:{m:02d}:00", m) for m in (0, 20, 30, 31, 50)], "k string, t string, i int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.i: r.anchor.minute for r in timeline.anchored(x, "k", "t", "i", 1800).collect()}
    assert got == {0: 0, 20: 0, 30: 0, 31: 31, 50: 31}


def test_revisions(spark):
    old = spark.createDataFrame([(1, "a", 3), (2, None, 1)], "k int, v string, revision long")
    new = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "k int, v string")
    assert {r.k: r.revision for r in tables.revised(new, old, "k", ["v"]).collect()} == {1: 4, 2: 1, 3: 1}


def test_guard_rejects_private_names(spark):
    with pytest.raises(ValueError):
        tables.guard(spark.createDataFrame([(1, "x")], "n int, customer_mobile string"))


def test_hull_and_inside(spark):
    ring = geo.hull(np.array([(0, 0), (0, 4), (4, 4), (4, 0), (2, 2), (0, 0)]))
    assert len(ring) == 4
    df = spark.createDataFrame([(2.0, 2.0), (0.0, 2.0), (5.0, 2.0)], "a double, o double")
    r = F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ring))
    assert [x.i for x in df.select(geo.inside(F.col("a"), F.col("o"), r).alias("i")).collect()] == [True, True, False]
