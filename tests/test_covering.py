"""Points in polygons by coverings, against a ray test of every point."""

import math
import random

from pyspark.sql import functions as F

from quietline.operators import geo


def star(r, lat, lon, radius, n):
    turn = r.random()
    return [{"lat": lat + radius * (1 if k % 2 else 0.4) * math.cos(turn + 2 * math.pi * k / n), "lon": lon + radius * (1 if k % 2 else 0.4) * math.sin(turn + 2 * math.pi * k / n)} for k in range(n)]


def test_stars(spark):
    r = random.Random(8)
    rings = [(k, star(r, 20 + r.random() * 3, 77 + r.random() * 3, r.choice([0.003, 0.1, 2.0, 9.0]), r.choice([4, 6, 11]))) for k in range(25)]
    rings += [(90, [{"lat": 20.0, "lon": 77.0}, {"lat": 20.0, "lon": 78.0}, {"lat": 21.0, "lon": 78.0}, {"lat": 21.0, "lon": 77.0}]), (91, [])]
    points = [(i, 18 + r.random() * 7, 75 + r.random() * 7) for i in range(1500)]
    points += [(5000 + k, p["lat"], p["lon"]) for k, (_, ring) in enumerate(rings) for p in ring[:1]] + [(7000, 20.5, 77.0), (7001, 20.0, 77.5), (7002, None, 1.0)]
    points += [(8000 + i, 20.0 + i * 0.01, 77.0 + i * 0.01) for i in range(100)]
    ring = spark.createDataFrame(rings, "ring_id int, ring array<struct<lat:double,lon:double>>")
    at = spark.createDataFrame(points, "id int, lat double, lon double").repartition(4)
    got = {(x.ring_id, x.id) for x in geo.inside_rings(at, ring, "ring").collect()}
    every = at.where("lat IS NOT NULL").crossJoin(ring.where("size(ring) > 0")).where(geo.inside(F.col("lat"), F.col("lon"), F.col("ring")))
    assert got == {(x.ring_id, x.id) for x in every.collect()} and len(got) > 1000 and (90, 7000) in got and (90, 7001) in got
    rows = geo.inside_rings(at, ring, "ring").count()
    assert rows == len(got)  # a point meets one square of a ring


def test_inner_squares(spark):
    """A ring over a whole area sends few points to its edges."""
    ring = spark.createDataFrame([(1, [{"lat": a, "lon": b} for a, b in ((6.0, 68.0), (6.0, 98.0), (38.0, 98.0), (38.0, 68.0))])], "ring_id int, ring array<struct<lat:double,lon:double>>")
    cells = geo.covering(ring, "ring").groupBy("_inner").count().collect()
    assert sum(c["count"] for c in cells) < 1000
    r = random.Random(1)
    at = spark.createDataFrame([(i, 6 + r.random() * 32, 68 + r.random() * 30) for i in range(3000)], "id int, lat double, lon double")
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("_level"), geo.square("lat", geo.WIDEST / 2**k).alias("_x"), geo.square("lon", geo.WIDEST / 2**k).alias("_y")) for k in range(geo.SIZES))))
    met = at.withColumn("_s", levels).select("id", "_s.*").join(geo.covering(ring, "ring"), ["_level", "_x", "_y"])
    assert met.count() == 3000 and met.where("NOT _inner").count() < 600
