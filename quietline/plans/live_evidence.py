"""Queries of the live evidence: clusters, their refinement and stability, radii, gates, and who lies inside a group's border."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fibre, geo
from ..sources.tables import table
from .registry import query

#: Customers at places within some kilometres of the middle of their nation, by a rule.
PLACES_SQL = "pl AS (SELECT c_nationkey AS nation, c_custkey AS device, 20 + c_nationkey * 0.1::DOUBLE + ((c_custkey * 7919) % 1000) * 0.00003::DOUBLE + ((c_custkey % 9) // 8) * 0.02::DOUBLE AS lat, 77 + c_nationkey * 0.1::DOUBLE + ((c_custkey * 104729) % 997) * 0.00003::DOUBLE AS lon FROM customer)"
DISTANCE_SQL = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def clusters_sql(points: str, name: str, scale: float = 1.5, most: float = 1000.0) -> str:
    """CTEs that end in `name` (k, device, cluster), from points (k, device, lat, lon)."""
    d = DISTANCE_SQL.format(a="a", b="b")
    return f"""{name}_d AS (SELECT a.k, a.device AS a, b.device AS b, {d} AS d, least(3, count(*) OVER (PARTITION BY a.k, a.device)) AS third, row_number() OVER (PARTITION BY a.k, a.device ORDER BY {d}, b.device) AS n FROM {points} a JOIN {points} b ON a.k = b.k AND a.device <> b.device),
{name}_r AS (SELECT k, a, greatest(100.0, least({most}, max(CASE WHEN n = third THEN d END) * {scale})) AS r FROM {name}_d GROUP BY 1, 2),
{name}_e AS (SELECT DISTINCT x.k, x.a, x.b FROM {name}_d x JOIN {name}_r p ON p.k = x.k AND p.a = x.a JOIN {name}_r q ON q.k = x.k AND q.a = x.b WHERE x.d <= greatest(p.r, q.r)),
{name}_c AS (SELECT k, a, b FROM {name}_e UNION SELECT c.k, c.a, e.b FROM {name}_c c JOIN {name}_e e ON e.k = c.k AND e.a = c.b),
{name} AS (SELECT p.k, p.device, least(p.device, coalesce(min(c.b), p.device)) AS cluster FROM {points} p LEFT JOIN {name}_c c ON c.k = p.k AND c.a = p.device GROUP BY 1, 2)"""


RADII_SQL = f"""mid AS (SELECT k, cluster, median(lat) AS lat, median(lon) AS lon, count(*) AS n FROM pc GROUP BY 1, 2),
far AS (SELECT pc.k, pc.cluster, pc.device, m.n, {DISTANCE_SQL.format(a="m", b="pc")} AS d FROM pc JOIN mid m ON m.k = pc.k AND m.cluster = pc.cluster),
rk AS (SELECT *, row_number() OVER (PARTITION BY k, cluster ORDER BY d, device) AS i FROM far),
rad AS (SELECT k, cluster, n, {", ".join(f"round(max(CASE WHEN i = (n * {t} + 9) // 10 THEN d END), 1) AS {r}" for r, t in geo.RADII.items())} FROM rk GROUP BY 1, 2, 3)"""
FIRST_SQL = f"{PLACES_SQL}, p1 AS (SELECT nation AS k, device, lat, lon FROM pl), {clusters_sql('p1', 'c1')}, pc AS (SELECT p1.*, c1.cluster FROM p1 JOIN c1 USING (k, device)), {RADII_SQL}"


def places(spark, sf_dir):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    lat = 20 + n * F.lit(0.1) + (c * 7919 % 1000) * F.lit(0.00003) + F.floor((c % 9) / 8) * F.lit(0.02)
    return table(spark, sf_dir, "customer").select(n.alias("nation"), c.alias("device"), lat.alias("lat"), (77 + n * F.lit(0.1) + (c * 104729 % 997) * F.lit(0.00003)).alias("lon"))


def clustered(spark, sf_dir):
    p = places(spark, sf_dir)
    return p.join(geo.clusters(p, "nation", "device"), ["nation", "device"])


@query("d1_clusters", f"WITH RECURSIVE {FIRST_SQL} SELECT k AS nation, device, cluster FROM c1")
def d1(spark, sf_dir):
    return geo.clusters(places(spark, sf_dir), "nation", "device")


@query("a22_radii", f"WITH RECURSIVE {FIRST_SQL} SELECT k AS nation, cluster, n, r70, r80, r90, r100 FROM rad")
def a22(spark, sf_dir):
    keys = ["nation", "cluster"]
    return geo.radii(geo.from_centre(clustered(spark, sf_dir), keys, "device"), keys)


@query("g8_core_and_tails", f"WITH RECURSIVE {FIRST_SQL} SELECT k AS nation, cluster, device, i <= (n * 9 + 9) // 10 AS core FROM rk")
def g8(spark, sf_dir):
    ranked = geo.from_centre(clustered(spark, sf_dir), ["nation", "cluster"], "device")
    return ranked.select("nation", "cluster", "device", geo.core(ranked).alias("core"))


@query("d7_support_gates", f"""WITH RECURSIVE {FIRST_SQL}, g AS (SELECT *, array_to_string(list_filter([CASE WHEN n < 10 THEN 'MIN_DOWN_MEMBERS' END, CASE WHEN r90 > 1000 THEN 'R90_OVER_1KM' END, CASE WHEN r90 - r80 > 500 THEN 'R80_R90_JUMP' END], lambda x: x IS NOT NULL), ',') AS reasons FROM rad)
SELECT k AS nation, cluster, reasons, reasons = '' AS supported, reasons IN ('', 'MIN_DOWN_MEMBERS') AS fibre_evaluable FROM g""")
def d7(spark, sf_dir):
    x = a22(spark, sf_dir).withColumn("reasons", F.array_join(geo.reasons(F.col("n"), F.col("r80"), F.col("r90")), ","))
    return x.select("nation", "cluster", "reasons", (F.col("reasons") == "").alias("supported"), F.col("reasons").isin("", "MIN_DOWN_MEMBERS").alias("fibre_evaluable"))


@query("d2_refined", f"""WITH RECURSIVE {FIRST_SQL}, wide AS (SELECT k, cluster FROM rad WHERE n >= 10 AND r90 - r80 > 500),
p2 AS (SELECT pc.k::BIGINT * 1000000000 + pc.cluster AS k, pc.device, pc.lat, pc.lon FROM pc JOIN wide USING (k, cluster)), {clusters_sql('p2', 'c2', 0.7, 500.0)}
SELECT c1.k AS nation, c1.device, c1.cluster, coalesce(c2.cluster, c1.cluster) AS part, c2.cluster IS NOT NULL AS split FROM c1 LEFT JOIN c2 ON c2.device = c1.device""")
def d2(spark, sf_dir):
    return geo.refined(places(spark, sf_dir), "nation", "device")


@query("d3_stability", f"""WITH RECURSIVE {FIRST_SQL}, p3 AS (SELECT k::BIGINT * 1000000000 + cluster AS k, device, lat, lon FROM pc), {clusters_sql('p3', 'lo', 0.85)}, {clusters_sql('p3', 'hi', 1.15)},
b AS (SELECT k, max(c) AS c FROM (SELECT k, cluster, count(*) AS c FROM lo GROUP BY 1, 2) GROUP BY 1 UNION ALL SELECT k, max(c) FROM (SELECT k, cluster, count(*) AS c FROM hi GROUP BY 1, 2) GROUP BY 1)
SELECT (b.k // 1000000000)::INT AS nation, b.k % 1000000000 AS cluster, round(min(b.c) / max(n.n)::DOUBLE, 3) AS stability FROM b JOIN (SELECT k, count(*) AS n FROM p3 GROUP BY 1) n USING (k) GROUP BY b.k""")
def d3(spark, sf_dir):
    return geo.stability(clustered(spark, sf_dir), "nation", "device", "cluster")


#: Squares around the middle of each nation; a point is inside where a ray from it crosses the border an odd number of times.
SQUARE_SQL = "sq AS (SELECT DISTINCT nation, 20 + nation * 0.1::DOUBLE + 0.004 AS a0, 20 + nation * 0.1::DOUBLE + 0.0171 AS a1, 77 + nation * 0.1::DOUBLE + 0.0033 AS o0, 77 + nation * 0.1::DOUBLE + 0.0207 AS o1 FROM pl)"


@query("j20_fleet_inside", f"WITH {PLACES_SQL}, {SQUARE_SQL} SELECT sq.nation, count(*) AS inside, min(device) AS first_device FROM sq JOIN pl ON lat BETWEEN a0 AND a1 AND lon BETWEEN o0 AND o1 GROUP BY 1")
def j20(spark, sf_dir):
    """The whole fleet against the groups' borders: points and rings meet in the cells of the rings' bounds, then rays decide."""
    p = places(spark, sf_dir)
    n = F.col("nation")
    lat, lon = lambda x: 20 + n * F.lit(0.1) + x, lambda x: 77 + n * F.lit(0.1) + x
    corner = lambda a, o: F.struct(lat(a).alias("lat"), lon(o).alias("lon"))
    ring = F.array(corner(0.004, 0.0033), corner(0.004, 0.0207), corner(0.0171, 0.0207), corner(0.0171, 0.0033))
    rings = p.select("nation").distinct().withColumn("ring", ring)
    return geo.inside_rings(p.select("device", "lat", "lon"), rings, "ring").groupBy("nation").agg(F.count("*").alias("inside"), F.min("device").alias("first_device"))


@query("g10_bounds", f"WITH {PLACES_SQL} SELECT nation, count(*) FILTER (lat * (device % 3) BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98) AS valid, count(*) AS n FROM pl GROUP BY 1")
def g10(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("lat", F.col("lat") * (F.col("device") % 3))
    return p.groupBy("nation").agg(F.count_if(geo.in_bounds(F.col("lat"), F.col("lon"))).alias("valid"), F.count("*").alias("n"))


@query("g3_f37_distances", f"WITH {PLACES_SQL} SELECT a.device, round({DISTANCE_SQL.format(a='a', b='b')}, 3) AS d FROM pl a JOIN pl b ON b.device = (a.device // 10) * 10")
def g3(spark, sf_dir):
    p = places(spark, sf_dir)
    b = p.select(F.col("device").alias("b"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    x = p.join(b, F.floor(p.device / 10) * 10 == b.b)
    return x.select("device", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")), 3).alias("d"))


@query("d9_fibre_evidence")
def d9(spark, sf_dir):
    """Outages are nations; a third of the devices has failed, and most have an address."""
    d = F.col("device")
    named = lambda letter, n, c: F.when(d % 5 > 0, F.concat(F.lit(letter), (c % n).cast("string")))
    x = places(spark, sf_dir).withColumns({"state": F.when(d % 3 == 0, "DOWN").when(d % 31 == 1, "UNKNOWN").otherwise("UP"), "house": named("h", 40, d), "road": named("r", 6, d), "locality": named("l", 5, d)})
    return fibre.evidence(x.withColumnRenamed("nation", "outage"))
