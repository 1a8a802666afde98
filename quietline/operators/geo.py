"""Places: square cells, distances, hulls, polygons, variable-density clusters, radii, support gates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut
from .graph import components

EARTH_M = 6_371_000.0


def square(value: Column | str, size: float = 0.01, shift: float = 0.0) -> Column:
    """Index of the square cell along one axis."""
    return F.floor((F.col(value) if isinstance(value, str) else value) / F.lit(size) - F.lit(shift / size))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def neighbours(cells: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """(x, y, around): the sum of the eight cells around each; every cell is sent to its neighbours, so the join is by equality."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    sent = cells.select(x, y, value, F.explode(steps).alias("s")).groupBy((F.col(x) + F.col("s.i")).alias(x), (F.col(y) + F.col("s.j")).alias(y)).agg(F.sum(value).alias("around"))
    return cells.select(x, y, value).join(sent, [x, y], "left").withColumn("around", F.coalesce("around", F.lit(0)))


def inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, array<struct<lat,lon>>, its border included; a sum over its edges."""
    edges = F.transform(ring, lambda p, k: F.struct(p.alias("a"), F.get(ring, F.pmod(k + 1, F.size(ring))).alias("b")))
    cross = lambda e: (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) - (e["b"]["lat"] - e["a"]["lat"]) * (lon - e["a"]["lon"])
    within = lambda v, p, q: v.between(F.least(p, q) - 1e-12, F.greatest(p, q) + 1e-12)
    border = F.exists(edges, lambda e: (F.abs(cross(e)) <= 1e-12) & within(lat, e["a"]["lat"], e["b"]["lat"]) & within(lon, e["a"]["lon"], e["b"]["lon"]))
    over = lambda e: (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)
    left = lambda e: lon < e["a"]["lon"] + (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0))
    hits = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(over(e) & left(e), 1).otherwise(0))
    return border | (hits % 2 == 1)


def hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Convex hull of (lat, lon) rows, counter-clockwise from the lowest; fewer than three unique points give them back."""
    pts = sorted({(float(a), float(b)) for a, b in points})
    if len(pts) < 3:
        return pts

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(pts)[:-1] + half(pts[::-1])[:-1]


def hulls(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, ring): the hull of each key's points.

    Tasks first reduce their own rows to hull corners, and the hull of those is the hull of all, so a key's group holds corners only.
    """
    kinds = dict(df.dtypes)

    def corners(batches):
        for pdf in batches:
            for k, g in pdf.groupby(key, dropna=False):
                ring = hull(g[[lat, lon]].to_numpy())
                yield pd.DataFrame({key: [k] * len(ring), lat: [p[0] for p in ring], lon: [p[1] for p in ring]})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull(pdf[[lat, lon]].to_numpy())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ring": [[{"lat": a, "lon": b} for a, b in ring]]})

    points = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(key, F.col(lat).cast("double").alias(lat), F.col(lon).cast("double").alias(lon))
    reduced = points.mapInPandas(corners, f"{key} {kinds[key]}, {lat} double, {lon} double")
    return reduced.groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, ring array<struct<lat:double,lon:double>>")


#: Metres of a degree of latitude.
DEGREE_M = EARTH_M * math.pi / 180


def _step(band: Column, side_m: float) -> Column:
    """Degrees of longitude that are `side_m` wide where a band of latitude is widest, so narrower elsewhere in it."""
    high = F.when(band >= 0, band).otherwise(-1 - band) * (side_m / DEGREE_M)
    return F.lit(side_m / DEGREE_M) / F.greatest(F.lit(0.01), F.cos(F.radians(high)))


def _squares(side_m: float, lat: str, lon: str) -> dict[str, Column]:
    """The square of a place: a band of latitude (_x) and a stretch of it (_y), neither wider than `side_m`."""
    band = F.floor(F.col(lat) / F.lit(side_m / DEGREE_M))
    return {"_x": band, "_y": F.floor(F.col(lon) / _step(band, side_m))}


def _sent(df: DataFrame, side_m: float, within_m: float, south: str, north: str, west: str, east: str) -> DataFrame:
    """`df` once for each square (_x, _y) that may hold a place at most `within_m` from the rectangle of a row."""
    reach = within_m / DEGREE_M * 1.001
    far = F.greatest(F.abs(south), F.abs(north)) + F.lit(reach)
    wide = F.lit(reach) / F.greatest(F.lit(0.01), F.cos(F.radians(far)))
    band = lambda c: F.floor(c / F.lit(side_m / DEGREE_M))
    x = df.withColumn("_wide", wide).withColumn("_x", F.explode(F.sequence(band(F.col(south) - reach), band(F.col(north) + reach))))
    step = _step(F.col("_x"), side_m)
    return x.withColumn("_y", F.explode(F.sequence(F.floor((F.col(west) - F.col("_wide")) / step), F.floor((F.col(east) + F.col("_wide")) / step)))).drop("_wide")


def _apart(high: Column, lat: Column, lon: Column) -> Column:
    """Metres between places so many degrees apart, at a latitude."""
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.pow(F.sin(F.radians(lat) / 2), 2) + F.pow(F.cos(F.radians(high)) * F.sin(F.radians(lon) / 2), 2))))


def _most_apart() -> Column:
    """At least the distance of any place of a row's rectangle from any of its other one (names with `o`)."""
    low = F.when((F.least("s", "os") <= 0) & (F.greatest("n", "on") >= 0), F.lit(0.0)).otherwise(F.least(F.abs("s"), F.abs("n"), F.abs("os"), F.abs("on")))
    return _apart(low, F.greatest("n", "on") - F.least("s", "os"), F.greatest("e", "oe") - F.least("w", "ow")) * (1 + 1e-9)


def _least_apart() -> Column:
    """At most the distance of any place of a row's rectangle from any of its other one (names with `o`)."""
    gap = lambda lo, hi, olo, ohi: F.greatest(F.lit(0.0), F.col(lo) - F.col(ohi), F.col(olo) - F.col(hi))
    high = F.greatest(F.abs("s"), F.abs("n"), F.abs("os"), F.abs("on"))
    return _apart(high, gap("s", "n", "os", "on"), gap("w", "e", "ow", "oe")) * (1 - 1e-9)


def _met(some: DataFrame, points: DataFrame, key: str, ident: str, lat: str, lon: str, side_m: float, within_m: float) -> DataFrame:
    """(all of some, b, _b, d): the other points of its key at most `within_m` from a point (a, _lat, _lon)."""
    other = points.select(key, F.col(ident).alias("b"), F.col("node").alias("_b"), F.col(lat).alias("_la"), F.col(lon).alias("_lo")).withColumns(_squares(side_m, "_la", "_lo"))
    x = _sent(some, side_m, within_m, "_lat", "_lat", "_lon", "_lon").join(other.hint("merge"), [key, "_x", "_y"]).where("a != b").drop("_x", "_y")
    return x.withColumn("d", haversine(F.col("_lat"), F.col("_lon"), F.col("_la"), F.col("_lo"))).where(F.col("d") <= within_m).drop("_la", "_lo")


def _far_reaching(points: DataFrame, cells: DataFrame, key: str, ident: str, lat: str, lon: str, scale: float, floor: float, most: float) -> DataFrame:
    """(key, a, _lat, _lon, node, reach) of the points that reach further than `floor`.

    A square holds no two points more than floor / scale apart, so with four points in it none of them reaches further. The
    others look for their third neighbour around them, then those that have none there twice as far away, and so on; the more
    they look at, the fewer they are.
    """
    total = cells.groupBy(key).agg(F.least(F.lit(3), F.sum("size") - 1).alias("_k"))
    thin = points.join(cells.where("size < 4").select("node").hint("merge"), "node").join(total, key)
    left = thin.select(key, F.col(ident).alias("a"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), "node", "_k")
    step = floor / scale
    near = _met(left, points, key, ident, lat, lon, step, step).groupBy(key, "a").agg(F.count("*").alias("_n"))
    left = cut(left.join(near.hint("merge"), [key, "a"], "left").where("coalesce(_n, 0) < _k").drop("_n"))
    found = []
    while step < most / scale and not left.isEmpty():
        step = min(2 * step, most / scale)
        by = Window.partitionBy(key, "a").orderBy("d")
        ranked = _met(left, points, key, ident, lat, lon, step, step).select(key, "a", "_k", "d").withColumn("_i", F.row_number().over(by)).where("_i <= 3")
        third = ranked.where("_i = _k").select(key, "a", F.greatest(F.lit(floor), F.least(F.lit(most), F.col("d") * scale)).alias("reach"))
        seen = cut(left.join(third.hint("merge"), [key, "a"], "left"))
        found.append(seen.where("reach IS NOT NULL"))
        left = seen.where("reach IS NULL").drop("reach")
    out = left.withColumn("reach", F.lit(float(most)))
    for x in found:
        out = out.unionByName(x)
    return out.where(F.col("reach") > floor)


def clusters(df: DataFrame, key: str, ident: str, lat: str = "lat", lon: str = "lon", scale: float = 1.5, floor: float = 100.0, most: float = 1000.0) -> DataFrame:
    """(key, ident, cluster): variable-density clusters of a key's points, named by their smallest ident.

    A point reaches as far as its third neighbour (of few points: the last) times `scale`, from `floor` to `most` metres; two
    points are joined if either reaches the other. All points of a small square are within `floor` of each other, so squares
    are joined, not points: squares side by side at once, then points that reach further with what they reach (few around any
    place, as all have at most two neighbours nearby), then, by their points, squares of different groups within `floor`. So
    dense places cost no more than their squares, but for two heaps that lie just about `floor` apart and aren't joined
    otherwise: the places at their borders are compared in pairs.
    """
    side = min(floor / 2, floor / scale) / math.sqrt(2) * 0.999
    points = df.select(key, ident, F.col(lat).cast("double").alias(lat), F.col(lon).cast("double").alias(lon)).dropna()
    points = cut(points.withColumns(_squares(side, lat, lon)).select(key, ident, lat, lon, F.xxhash64(key, "_x", "_y").alias("node"), "_x", "_y"))
    bounds = F.min(lat).alias("s"), F.max(lat).alias("n"), F.min(lon).alias("w"), F.max(lon).alias("e")
    cells = cut(points.groupBy(key, "_x", "_y", "node").agg(F.count("*").alias("size"), F.min(ident).alias("first"), *bounds))

    def beside(some, every, within_m):
        """Cells of `some` and of `every` in squares at most `within_m` apart."""
        own = _sent(some.drop("_x", "_y", "size", "first"), side, within_m, "s", "n", "w", "e")
        return own.join(every.drop("size", "first").withColumnsRenamed({c: f"o{c}" for c in every.columns if c not in (key, "_x", "_y")}).hint("merge"), [key, "_x", "_y"]).where("node != onode")

    edge = lambda x, a, b: x.select(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = edge(beside(cells, cells, side).where(_most_apart() <= floor), "node", "onode")
    far = cut(_far_reaching(points, cells, key, ident, lat, lon, scale, floor, most))
    size = 2 * floor
    while not far.isEmpty():
        now, far = far.where(F.col("reach") <= size), far.where(F.col("reach") > size)
        edges = edges.unionByName(edge(_met(now, points, key, ident, lat, lon, size, size).where("d <= reach AND node != _b"), "node", "_b"))
        size *= 2
    roots = components(edges).withColumnRenamed("root", "group")
    cells = cut(cells.join(roots.hint("merge"), "node", "left").withColumn("group", F.coalesce("group", "node")))
    # What is left is within `floor` of another group; the largest group of a key needn't look for the others.
    groups = cells.groupBy(key, "group").agg(F.count("*").alias("_n"))
    largest = groups.groupBy(key).agg(F.max(F.struct("_n", "group"))["group"].alias("_largest"), F.count("*").alias("_groups"))
    small = cells.join(largest.where("_groups > 1"), key).where("group != _largest").drop("_largest", "_groups")
    pairs = cut(beside(small, cells, floor).where("group != ogroup").where(_least_apart() <= floor))
    if not pairs.isEmpty():
        places = points.select("node", F.col(lat).alias("_la"), F.col(lon).alias("_lo")).distinct()
        own = pairs.join(places.hint("merge"), "node").withColumns({"s": F.col("_la"), "n": F.col("_la"), "w": F.col("_lo"), "e": F.col("_lo")}).where(_least_apart() <= floor).drop("_la", "_lo")
        other = places.withColumnRenamed("node", "onode")
        near = own.join(other.hint("merge"), "onode").where(haversine(F.col("s"), F.col("w"), F.col("_la"), F.col("_lo")) <= floor)
        roots = components(edge(near, "group", "ogroup")).withColumnRenamed("node", "group")
        cells = cells.join(roots, "group", "left").withColumn("group", F.coalesce("root", "group"))
    names = cells.groupBy(key, "group").agg(F.min("first").alias("cluster"))
    return points.select(key, ident, "node").join(cells.select(key, "group", "node").join(names, [key, "group"]).select("node", "cluster").hint("merge"), "node").select(key, ident, "cluster")


#: Shares of a group within its radii.
RADII = {"r70": 7, "r80": 8, "r90": 9, "r100": 10}


def from_centre(df: DataFrame, keys: list[str], ident: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(keys, ident, d, k, n): distance of each point to the median place of its group, its rank (ties by ident), and their number."""
    middle = df.groupBy(*keys).agg(F.median(lat).alias("_a"), F.median(lon).alias("_o"), F.count("*").alias("n"))
    d = haversine(F.col("_a"), F.col("_o"), F.col(lat), F.col(lon))
    x = df.join(middle, keys).select(*keys, ident, d.alias("d"), "n")
    return x.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("d", ident)))


def radii(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, r70 .. r100): nearest-rank distances, to a tenth of a metre, from what `from_centre` gives."""
    at = {name: F.floor((F.col("n") * tenths + 9) / 10) for name, tenths in RADII.items()}
    rows = [F.round(F.max(F.when(F.col("k") == k, F.col("d"))), 1).alias(name) for name, k in at.items()]
    return ranked.groupBy(*keys, "n").agg(*rows)


def core(ranked: DataFrame) -> Column:
    """Whether a point is among the nine tenths nearest to the centre; the others are tails."""
    return F.col("k") <= F.floor((F.col("n") * 9 + 9) / 10)


def refined(df: DataFrame, key: str, ident: str, lat: str = "lat", lon: str = "lon", jump_m: float = 500.0, least: int = 10) -> DataFrame:
    """(key, ident, cluster, part, split): clusters, of which large ones whose radius jumps between R80 and R90 are clustered again.

    Once only, with a shorter reach; a cluster that stays whole is marked as tried, too.
    """
    first = clusters(df, key, ident, lat, lon)
    places = df.select(key, ident, lat, lon).join(first, [key, ident])
    groups = radii(from_centre(places, [key, "cluster"], ident, lat, lon), [key, "cluster"])
    wide = groups.where((F.col("n") >= least) & (F.col("r90") - F.col("r80") > jump_m)).select(key, "cluster").withColumn("split", F.lit(True))
    again = places.join(wide, [key, "cluster"]).withColumn("_g", F.struct(key, "cluster"))
    parts = clusters(again, "_g", ident, lat, lon, scale=0.7, most=500.0)
    parts = parts.select(F.col(f"_g.{key}").alias(key), ident, F.col("cluster").alias("part"), F.lit(True).alias("split"))
    out = first.join(parts, [key, ident], "left")
    return out.select(key, ident, "cluster", F.coalesce("part", "cluster").alias("part"), F.coalesce("split", F.lit(False)).alias("split"))


def stability(df: DataFrame, key: str, ident: str, cluster: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, cluster, stability): the least share of a cluster that stays together when its reach shrinks or grows by 15 percent."""
    own = df.select(key, cluster, ident, lat, lon).withColumn("_g", F.struct(key, cluster))
    n = own.groupBy("_g").agg(F.count("*").alias("n"))
    out = None
    for scale in (0.85, 1.15):
        c = clusters(own, "_g", ident, lat, lon, scale=scale).groupBy("_g", "cluster").agg(F.count("*").alias("c"))
        best = c.groupBy("_g").agg(F.max("c").alias("c"))
        out = best if out is None else out.unionByName(best)
    share = out.groupBy("_g").agg(F.min("c").alias("c")).join(n, "_g")
    return share.select(F.col(f"_g.{key}").alias(key), F.col(f"_g.{cluster}").alias(cluster), F.round(F.col("c") / F.col("n"), 3).alias("stability"))


def reasons(n: Column, r80: Column, r90: Column) -> Column:
    """Why a group's place doesn't support a decision: the names of the gates that fail, in order."""
    gates = (("MIN_DOWN_MEMBERS", n < 10), ("R90_OVER_1KM", r90 > 1000), ("R80_R90_JUMP", r90 - r80 > 500))
    return F.array_compact(F.array(*(F.when(holds, name) for name, holds in gates)))


def in_bounds(lat: Column, lon: Column, south: float = 6, north: float = 38, west: float = 68, east: float = 98) -> Column:
    """Whether a place lies in the service area; a null doesn't."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


#: Degrees of the widest squares, sizes of squares (each half as wide as the one before), and how often one on a border is cut.
WIDEST, SIZES, CUTS = 40.96, 14, 5


def _meets(ring: Column, lat: Column, lon: Column, size: Column) -> Column:
    """Whether an edge of a ring meets the square that begins at a place: no line along a side or along the edge parts them."""
    eps = 1e-9
    south, north, west, east = lat - eps, lat + (size + eps), lon - eps, lon + (size + eps)
    edges = F.transform(ring, lambda p, k: F.struct(p.alias("a"), F.get(ring, F.pmod(k + 1, F.size(ring))).alias("b")))

    def meets(e):
        a, b = e["a"], e["b"]
        beside = (F.greatest(a["lat"], b["lat"]) < south) | (F.least(a["lat"], b["lat"]) > north) | (F.greatest(a["lon"], b["lon"]) < west) | (F.least(a["lon"], b["lon"]) > east)
        side = lambda y, x: (b["lon"] - a["lon"]) * (y - a["lat"]) - (b["lat"] - a["lat"]) * (x - a["lon"])
        corners = [side(y, x) for y in (south, north) for x in (west, east)]
        return ~beside & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.exists(edges, meets)


def covering(rings: DataFrame, ring: str) -> DataFrame:
    """`rings` with (_level, _x, _y, _inner): squares that cover each ring, and whether they lie in it wholly.

    Squares begin about as wide as the ring. One that no edge meets is in the ring or goes, by its middle; one that an edge
    meets is cut into four, CUTS times. So a ring of any size has some hundred squares along its border, and only those need
    its edges. One pass: a square that is settled is handed on as it is.
    """
    bound = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    extent = F.greatest(*(bound(F.array_max, c) - bound(F.array_min, c) for c in ("lat", "lon")), F.lit(1e-9))
    top = F.greatest(F.lit(0), F.least(F.lit(SIZES - 1), F.floor(F.log2(WIDEST / extent)))).cast("int")
    size = F.lit(WIDEST) / F.pow(F.lit(2.0), F.col("_level"))
    span = lambda c: F.explode(F.sequence(F.floor(bound(F.array_min, c) / size), F.floor(bound(F.array_max, c) / size)))
    own = rings.columns
    x = rings.where(F.size(ring) > 0).withColumn("_level", top).withColumn("_x", span("lat")).withColumn("_y", span("lon")).withColumn("_inner", F.lit(None).cast("boolean"))
    four = [F.struct((F.col("_level") + 1).alias("_level"), (F.col("_x") * 2 + i).alias("_x"), (F.col("_y") * 2 + j).alias("_y"), F.lit(None).cast("boolean").alias("_inner")) for i in (0, 1) for j in (0, 1)]
    lat, lon = F.col("_x") * size, F.col("_y") * size
    for cut_ in range(CUTS + 1):
        x = x.withColumn("_edge", F.col("_inner").isNull() & _meets(F.col(ring), lat, lon, size))
        x = x.where(F.col("_edge") | F.col("_inner").isNotNull() | inside(lat + size / 2, lon + size / 2, F.col(ring)))
        settle = lambda inner: F.array(F.struct("_level", "_x", "_y", inner.alias("_inner")))
        last = F.lit(cut_ == CUTS) | (F.col("_level") >= SIZES - 1)
        nxt = F.when(~F.col("_edge"), settle(F.lit(True))).when(last, settle(F.lit(False))).otherwise(F.array(*four)) if cut_ < CUTS else settle(~F.col("_edge"))
        # A border square of the smallest size is settled, too.
        x = x.withColumn("_s", F.explode(F.when(F.col("_inner").isNotNull(), settle(F.col("_inner"))).otherwise(nxt))).select(*own, "_s.*")
    return x


def inside_rings(points: DataFrame, rings: DataFrame, ring: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points with the columns of each ring that they lie in, its border included.

    Points meet the squares of the rings' coverings by equality, one at each size. Only those in a square that an edge meets
    are held against the edges. Neither side is sent whole, however small the files that it is made of.
    """
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("_level"), square(lat, WIDEST / 2**k).alias("_x"), square(lon, WIDEST / 2**k).alias("_y")) for k in range(SIZES))))
    own = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_s", levels).select(*points.columns, "_s.*")
    met = own.join(covering(rings, ring).hint("merge"), ["_level", "_x", "_y"])
    return met.where(F.col("_inner") | inside(F.col(lat), F.col(lon), F.col(ring))).drop("_level", "_x", "_y", "_inner")


def circle(lat: float, lon: float, radius_m: float, corners: int = 24, least_m: float = 20.0) -> list[tuple[float, float]]:
    """A ring around a point, for groups that have no hull."""
    r = max(radius_m, least_m) / EARTH_M
    return [(lat + math.degrees(r * math.cos(t)), lon + math.degrees(r * math.sin(t) / max(1e-9, math.cos(math.radians(lat))))) for t in (2 * math.pi * k / corners for k in range(corners))]


def profile(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, n, length_m, across_p90_m, ratio): how far a group's points stretch along and across their main axis.

    East and north in metres from the mean place; variances and covariance are aggregates, and their principal axis follows
    from half the angle of (2 cov, var east - var north). The ratio of the axes' spreads is at most 999, and 0 where there is
    no spread at all.
    """
    known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    mean = known.groupBy(key).agg(F.avg(lat).alias("_a"), F.avg(lon).alias("_o"))
    east = (F.col(lon) - F.col("_o")) * DEGREE_M * F.cos(F.radians("_a"))
    placed = known.join(mean, key).select(key, east.alias("_east"), ((F.col(lat) - F.col("_a")) * DEGREE_M).alias("_north"))
    spread = placed.groupBy(key).agg(F.var_pop("_east").alias("_ve"), F.var_pop("_north").alias("_vn"), F.covar_pop("_east", "_north").alias("_c"))
    half_sum, half_gap = (F.col("_ve") + F.col("_vn")) / 2, F.hypot((F.col("_ve") - F.col("_vn")) / 2, F.col("_c"))
    angle = F.atan2(2 * F.col("_c"), F.col("_ve") - F.col("_vn")) / 2
    axes = spread.select(key, angle.alias("_t"), (half_sum + half_gap).alias("_long"), F.greatest(F.lit(0.0), half_sum - half_gap).alias("_short"))
    along = F.col("_east") * F.cos("_t") + F.col("_north") * F.sin("_t")
    across = F.abs(F.col("_north") * F.cos("_t") - F.col("_east") * F.sin("_t"))
    turned = placed.join(axes, key).select(key, "_long", "_short", along.alias("_u"), across.alias("_w"))
    ratio = F.when(F.max("_short") > 1e-9, F.least(F.lit(999.0), F.sqrt(F.max("_long") / F.max("_short")))).when(F.max("_long") > 1e-9, 999.0).otherwise(0.0)
    p90 = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY _w)")
    return turned.groupBy(key).agg(F.count("*").alias("n"), F.round(F.max("_u") - F.min("_u"), 1).alias("length_m"), F.round(p90, 1).alias("across_p90_m"), F.round(ratio, 2).alias("ratio"))


#: Half axis in metres and eccentricity of the WGS84 ellipsoid.
WGS84_A, WGS84_E = 6_378_137.0, 0.0818191908426215


def area_km2(ring: Column) -> Column:
    """Area of a ring, array<struct<lat,lon>>, on WGS84: its edges are straight between authalic latitudes, which keep areas."""
    e = WGS84_E

    def q(lat):
        s = F.sin(F.radians(lat))
        return F.lit(1 - e * e) * (s / (1 - F.lit(e * e) * s * s) - F.lit(1 / (2 * e)) * F.ln((1 - F.lit(e) * s) / (1 + F.lit(e) * s)))

    points = F.transform(ring, lambda p: F.struct(q(p["lat"]).alias("q"), F.radians(p["lon"]).alias("l")))
    edges = F.transform(points, lambda p, k: (F.get(points, F.pmod(k + 1, F.size(ring)))["l"] - p["l"]) * (p["q"] + F.get(points, F.pmod(k + 1, F.size(ring)))["q"]) / 2)
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda a, b: a + b)) * F.lit(WGS84_A**2 / 2 / 1e6)


def hexagon(lat: Column, lon: Column, side_m: float = 200.0, at: float = 0.0) -> Column:
    """struct<q,r> of the hexagon, pointed at the top, that a place falls into, on a plane that is true at latitude `at`."""
    x, y = F.radians(lon) * F.lit(EARTH_M * math.cos(math.radians(at)) / side_m), F.radians(lat) * F.lit(EARTH_M / side_m)
    q, r = x * F.lit(math.sqrt(3) / 3) - y / 3, y * F.lit(2 / 3)
    a, b, c = F.rint(q), F.rint(r), F.rint(-q - r)
    da, db, dc = F.abs(a - q), F.abs(b - r), F.abs(c + q + r)
    wide, tall = (da > db) & (da > dc), db > dc
    return F.struct(F.when(wide, -b - c).otherwise(a).cast("long").alias("q"), F.when(~wide & tall, -a - c).otherwise(b).cast("long").alias("r"))
