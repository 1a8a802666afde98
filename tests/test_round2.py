"""Operators of the engine against brute force and odd rows."""

import datetime as dt
import gzip
import json
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quietline.operators import geo, graph, hours, scores, timeline
from quietline.sources import feeds, tables


def metres(a, b):
    (la, lo), (lb, mo) = [tuple(map(math.radians, x)) for x in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1, h)))


def brute_clusters(points, scale, floor, most):
    label = {i: i for i in points}
    reach = {}
    for i, p in points.items():
        d = sorted(metres(p, q) for j, q in points.items() if j != i)
        reach[i] = min(most, max(floor, d[min(3, len(d)) - 1] * scale)) if d else 0
    for _ in points:
        for i in points:
            for j in points:
                if i != j and metres(points[i], points[j]) <= max(reach[i], reach[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("scale, most", [(1.5, 1000.0), (0.7, 500.0)])
def test_clusters(spark, scale, most):
    rnd = random.Random(8)
    groups = {k: {100 * k + i: (20 + rnd.gauss(0, 0.01), 77 + rnd.gauss(0, 0.01)) for i in range(n)} for k, n in ((1, 30), (2, 2), (3, 1), (4, 3))}
    rows = [(k, i, *p) for k, g in groups.items() for i, p in g.items()] + [(5, 9, None, 77.0)]
    df = spark.createDataFrame(rows, "key long, id long, lat double, lon double")
    got = {(r.key, r.id): r.cluster for r in geo.clusters(df, "key", "id", scale=scale, most=most).collect()}
    assert got == {(k, i): c for k, g in groups.items() for i, c in brute_clusters(g, scale, 100.0, most).items()}


@pytest.mark.parametrize("lot", [500_000, 20])
def test_components(spark, monkeypatch, lot):
    monkeypatch.setattr(graph, "LOT", lot)
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(200)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_anchored(spark):
    rnd, start = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(rnd.choice("abc"), start + dt.timedelta(seconds=rnd.randrange(4000), microseconds=rnd.randrange(9) * 100_000), i) for i in range(400)] + [("d", start, 999)]
    want, open_ = {}, {}
    for k, t, i in sorted(rows):
        if k not in open_ or (t.replace(microsecond=0) - open_[k].replace(microsecond=0)).total_seconds() > 300:
            open_[k] = t
        want[i] = open_[k]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i long").repartition(3)
    assert {r.i: r.anchor for r in timeline.anchored(df, "k", "t", "i", 300).collect()} == want


def test_running_sums(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "i long, v long").repartition(6)
    rows = scores.running(df, [F.desc("v"), F.col("i")], {"k": F.lit(1), "s": F.col("v")}).collect()
    order = sorted(range(500), key=lambda i: (-(i % 7), i))
    at, total = {}, 0
    for k, i in enumerate(order, 1):
        total += i % 7
        at[i] = (k, total)
    assert {r.i: (r.k, r.s) for r in rows} == at


def test_hours_of_a_device_without_rows(spark):
    roster = spark.createDataFrame([(1, 1), (2, 1)], "device long, cell long")
    one = spark.createDataFrame([(1, "2024-01-01 01:00:00", "111111111111", 0)], "device long, hour string, bitmap string, bad int").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    x = hours.with_misses(roster, one, "2024-01-01 00:00:00", "2024-01-01 02:00:00")
    assert x.count() == 6 and x.where(F.col("bitmap") == hours.MISSED).count() == 5
    states = hours.quarter_states(x)
    assert states.where("device = 2").agg(F.min(F.col("outage").cast("int"))).first()[0] == 1
    first = states.where("device = 1").orderBy("anchor").collect()
    assert [r.outage for r in first] == [False] * 7 + [True] and [r.early for r in first] == [False] * 4 + [True] * 3 + [False]


def test_contracts(spark):
    folder = tempfile.mkdtemp(prefix="spark-test-")
    with gzip.open(f"{folder}/x.csv.gz", "wt") as f:
        f.write("id,v\n1,a\n1,b\n2,\n")
    x = tables.csv_table(spark, folder, "id long, v string")
    bad = tables.violations(x, "id", {"v": F.col("v").isNotNull()}, ("v",))
    assert {r.rule: r.n for r in bad.collect()} == {"v": 1, "one_v": 1}
    with pytest.raises(ValueError, match="contract"):
        tables.require(bad)
    with pytest.raises(Exception, match="too old"):
        tables.csv_table(spark, folder, "id long, v string", gate_hours=1, as_of="2020-01-01 00:00:00").count()
    assert tables.require(bad.where("n > 9")) is None


def test_status_has_one_row_an_id(spark):
    devices = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert {(r.id, r.v) for r in feeds.status(devices, spark.createDataFrame([(1, "x")], "id long, v string"), "id").collect()} == {(1, "x"), (2, None)}
    with pytest.raises(Exception, match="twice"):
        feeds.status(devices, spark.createDataFrame([(1, "x"), (1, "y")], "id long, v string"), "id").collect()


def test_geojson_and_circle(spark):
    ring = geo.circle(20.0, 77.0, 5.0)
    assert all(19 < metres((20.0, 77.0), p) < 21 for p in ring) and len(ring) == 24
    g = json.dumps({"type": "Polygon", "coordinates": [[[b, a] for a, b in ring]]})
    rows = tables.geojson(spark.createDataFrame([(2, g), (1, g)], "id long, g string"), "g", ["id"], ["id"]).collect()
    assert [json.loads(r.value)["properties"]["id"] for r in rows] == [1, 2] and json.loads(rows[0].value)["geometry"]["type"] == "Polygon"


def test_payload_of_several_words(spark):
    words = [(1 << 59) + 5, 3, 0]
    whole = sum(w << (60 * k) for k, w in enumerate(words))
    import base64

    want = base64.b64encode(whole.to_bytes(23, "little")).decode()
    df = spark.createDataFrame([(1, words), (2, [0, 0, 0])], "id long, w array<long>")
    got = {r.id: r.b for r in df.select("id", feeds.bitmap64(F.col("w"), 23).alias("b")).collect()}
    assert got == {1: want, 2: ""}
