"""Cases of the third review, each of which failed before."""

import duckdb
import numpy as np
import pytest

from quietline import catalog
from quietline.operators import geo, hours, leaves
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"


def test_days_begin_at_the_nearest_second(spark, tmp_path):
    """an event in a day's last half second."""
    times = ("2024-01-02 23:59:59.6", "2024-01-02 23:59:59.5", "2024-01-02 23:59:59.4", "1969-12-31 23:59:58", "2024-01-30 12:00:00.5")
    rows = ", ".join(f"({i}, TIMESTAMP '{t}', 1, 'view', 1.5)" for i, t in enumerate(times))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    name = "p22_p24_p16_reboot_features"
    assert oracle.compare(spark, oracle.connection(str(tmp_path)), catalog.queries()[name], catalog.oracle_sql()[name], str(tmp_path)) == ""


def test_runs_say_what_has_recovered(spark):
    """F16: a success is recovered from its recovery's time on, and no failure is."""
    runs = catalog.queries()["x1_x2_x8_device_runs"](spark, SF_DIR)
    back = {(r.device, r.run_start): r.recovered_at for r in catalog.queries()["x8_recoveries"](spark, SF_DIR).collect()}
    got = runs.collect()
    assert [r.recovered for r in got] == [r.up and back.get((r.device, r.run_start), r.ts.max) <= r.ts for r in got] and any(r.recovered for r in got)


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [10, 1000])
def test_hours_are_not_sent_whole(spark, n):
    """A roster of few bytes has 36 times as many rows once its hours are made."""
    roster = spark.range(n).withColumnRenamed("id", "device")
    made = roster.selectExpr("device", "timestamp_ntz'2024-01-05 00:00:00' AS hour", "'111111111111' AS bitmap", "0 AS bad")
    x = hours.with_misses(roster, made, "2024-01-05 00:00:00", "2024-01-06 11:00:00")
    assert "BroadcastHashJoin" not in planned(x) and x.count() == 36 * n


def test_points_are_not_sent_whole(spark):
    """points are held at each size of squares, so their files say little of them."""
    points = spark.range(1000).selectExpr("id", "20 + id * 0.00001 AS lat", "77 + id * 0.00001 AS lon")
    rings = spark.range(1).selectExpr("id AS ring_id", "array(named_struct('lat', 20D, 'lon', 77D), named_struct('lat', 20D, 'lon', 78D), named_struct('lat', 21D, 'lon', 77D)) AS ring")
    x = geo.inside_rings(points, rings, "ring")
    assert "BroadcastHashJoin" not in planned(x) and x.count() == 1000


def reached(lat, lon, scale, most):
    """Clusters of all points by all pairs: position of the smallest member of each."""
    a, o = np.radians(lat), np.radians(lon)
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a[:, None]) * np.cos(a) * np.sin((o[:, None] - o) / 2) ** 2
    d = 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h)))
    third = np.sort(d + np.diag(np.full(len(d), np.inf)), axis=1)[:, min(3, len(d) - 1) - 1]
    reach = np.maximum(100.0, np.minimum(most, third * scale))
    joined, label = d <= np.maximum(reach[:, None], reach), np.arange(len(d))
    while (new := np.where(joined, label, len(d)).min(axis=1)).tolist() != label.tolist():
        label = new
    return label


@pytest.mark.parametrize("lat0, lon0", [(20, 77), (-33.9, -70.6), (64, 0)])
@pytest.mark.parametrize("scale, most", [(1.5, 1000.0), (0.7, 500.0), (0.5, 250.0)])
def test_dense_clusters(spark, lat0, lon0, scale, most):
    """Heaps just within and just beyond the floor, a trail, lone points that reach a heap, copies."""
    r, metre = np.random.default_rng(5), 1 / geo.DEGREE_M
    parts = [r.uniform(0, 60, (300, 2)), r.uniform(0, 60, (300, 2)) + [158.5, 0], r.uniform(0, 60, (200, 2)) + [0, 161], np.repeat(r.uniform(0, 60, (4, 2)) + [600, 600], 40, axis=0)]
    parts += [np.array([[-450.0, 20], [700, 0], [1500, 0], [1600, 0], [1695, 5]]), r.normal(0, 900, (150, 2)) + [-4000, 0], np.stack([np.arange(60) * 97.0, np.full(60, 3000.0)], 1)]
    at = np.concatenate(parts)
    lat, lon = lat0 + at[:, 0] * metre, lon0 + at[:, 1] * metre / np.cos(np.radians(lat0))
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))] + [(2, 5, 20.0, 77.0)], "key int, id long, lat double, lon double").repartition(5)
    got = {(x.key, x.id): x.cluster for x in geo.clusters(df, "key", "id", scale=scale, most=most).collect()}
    assert got == {(1, i): c for i, c in enumerate(reached(lat, lon, scale, most))} | {(2, 5): 5}


def test_clusters_of_a_dense_place_compare_few_points(spark, monkeypatch):
    """Of 20,000 points within 600 metres no two are compared, so the answers don't wait for 4 x 10^8 pairs."""
    df = spark.range(20_000).selectExpr("1 AS key", "id", "20 + (id * 7919 % 1000) * 0.000005 AS lat", "77 + (id * 104729 % 997) * 0.000005 AS lon")
    met, counted = [], geo._met
    monkeypatch.setattr(geo, "_met", lambda *a: met.append((out := counted(*a)).count()) or out)
    assert geo.clusters(df, "key", "id").where("cluster = 0").count() == 20_000 and sum(met) < 20_000


def test_four_levels_take_one_round(spark, monkeypatch):
    """a document of four levels is stored once, not once a level; empty containers below have no leaves."""
    stored, cut = [], leaves.cut
    monkeypatch.setattr(leaves, "cut", lambda x: stored.append(1) or cut(x))
    df = spark.createDataFrame([(1, '{"a": [{"b": [1, null]}, 2], "c": {}, "d": [[[]]]}')], "k int, j string")
    got = {(x.path, x.value) for x in leaves.leaves(df, ["k"], "j").collect()}
    assert got == {("$.a[0].b[0]", "1"), ("$.a[0].b[1]", None), ("$.a[1]", "2")} and len(stored) == 1
