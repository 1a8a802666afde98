"""Study queries: cells and neighbours, bitmap states, triggers, model measures and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import bootstrap, geo, scores
from ..sources.tables import table
from .registry import query

GRID = "g AS (SELECT floor(embedding[1]::DOUBLE / 0.05)::BIGINT AS x, floor(embedding[2]::DOUBLE / 0.05)::BIGINT AS y, count(*) AS n FROM embeddings GROUP BY 1, 2)"


def grid(spark, sf_dir, shift=0.0):
    e = table(spark, sf_dir, "embeddings")
    axis = lambda k: F.floor(F.get("embedding", F.lit(k)).cast("double") / F.lit(0.05) - F.lit(shift))
    return e.groupBy(axis(0).alias("x"), axis(1).alias("y")).agg(F.count("*").alias("n"))


@query("j10_neighbours", f"WITH {GRID} SELECT a.x, a.y, a.n, coalesce(sum(b.n), 0)::BIGINT AS around FROM g a LEFT JOIN g b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY 1, 2, 3")
def j10(spark, sf_dir):
    return geo.neighbours(grid(spark, sf_dir), "x", "y", "n")


@query("u4_shifted_jaccard", f"WITH {GRID}, s AS (SELECT floor(embedding[1]::DOUBLE / 0.05 - 0.5)::BIGINT AS x, floor(embedding[2]::DOUBLE / 0.05 - 0.5)::BIGINT AS y, count(*) AS n FROM embeddings GROUP BY 1, 2), h AS (SELECT x, y FROM g WHERE n >= 8), t AS (SELECT x, y FROM s WHERE n >= 8), o AS (SELECT count(*) AS c FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j), h WHERE h.x = t.x + i AND h.y = t.y + j) SELECT (c * 0.25)::DOUBLE AS shared, (SELECT count(*) FROM h) AS base, (SELECT count(*) FROM t) AS shifted FROM o")
def u4(spark, sf_dir):
    hot, moved = grid(spark, sf_dir).where("n >= 8").select("x", "y"), grid(spark, sf_dir, 0.5).where("n >= 8").select("x", "y")
    four = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    over = moved.select((F.col("x")).alias("_x"), F.col("y").alias("_y"), F.explode(four).alias("s")).select((F.col("_x") + F.col("s.i")).alias("x"), (F.col("_y") + F.col("s.j")).alias("y")).join(hot, ["x", "y"])
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return over.agg((F.count("*") * 0.25).alias("shared")).crossJoin(one(hot, "base")).crossJoin(one(moved, "shifted"))


@query("d18_triggers", """WITH r AS (SELECT c_nationkey::BIGINT AS cell, count(*) AS roster FROM customer WHERE c_custkey IN (SELECT user_id FROM events) GROUP BY 1),
t AS (SELECT c_nationkey::BIGINT AS cell, date_trunc('hour', ts)::TIMESTAMP AS hour, count(DISTINCT user_id) AS failing FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'error' GROUP BY 1, 2),
g AS (SELECT cell, hour, failing, roster FROM t JOIN r USING (cell) WHERE failing >= ceil(roster * 0.1))
SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.cell = a.cell AND b.hour = a.hour - INTERVAL 1 HOUR)""")
def d18(spark, sf_dir):
    """Hours in which a tenth of a cell's roster fails, without one in the hour before."""
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("cell"))
    roster = c.join(e, "user_id", "left_semi").groupBy("cell").agg(F.count("*").alias("roster"))
    t = e.where("event_type = 'error'").join(c, "user_id").groupBy("cell", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count_distinct("user_id").alias("failing"))
    g = t.join(roster, "cell").where(F.col("failing") >= F.ceil(F.col("roster") * 0.1))
    return g.withColumn("p", F.lag("hour").over(Window.partitionBy("cell").orderBy("hour"))).where("p IS NULL OR p <> hour - INTERVAL 1 HOUR").select("cell", "hour", "failing", "roster")


@query("w14_top_decile", "SELECT o_custkey, total FROM (SELECT *, row_number() OVER (ORDER BY total DESC, o_custkey) AS k, count(*) OVER () AS n FROM (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1)) WHERE k <= ceil(0.1 * n)")
def w14(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"))
    ranked = scores.running(t, [F.desc("total"), F.col("o_custkey")], {"k": F.lit(1)})
    n = t.agg(F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(n)).where("k <= ceil(n / 10)").select("o_custkey", "total")


LABELS = "l AS (SELECT doc_id, n_chars, quality FROM labels JOIN documents USING (doc_id))"


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")


AP = "s AS (SELECT {by} n_chars, sum(quality) AS p, count(*) AS c FROM x GROUP BY ALL), t AS (SELECT {by} p, sum(p) OVER (w ORDER BY n_chars DESC) AS tp, sum(c) OVER (w ORDER BY n_chars DESC) AS k, sum(p) OVER (w) AS al FROM s WINDOW w AS ({part}))"


@query("m3_average_precision", f"WITH x AS (SELECT doc_id, n_chars, quality FROM labels JOIN documents USING (doc_id)), {AP.format(by='', part='')} SELECT sum(p::DOUBLE / al * tp / k)::DECIMAL(18,9) AS ap FROM t")
def m3(spark, sf_dir):
    return scores.average_precision(labelled(spark, sf_dir), "n_chars", "quality").select(F.col("ap").cast("decimal(18,9)").alias("ap"))


@query("m7_group_ap", f"WITH x AS (SELECT source, n_chars, quality FROM labels JOIN documents USING (doc_id)), {AP.format(by='source,', part='PARTITION BY source')} SELECT source, sum(p::DOUBLE / al * tp / k)::DECIMAL(18,9) AS ap FROM t WHERE al > 0 GROUP BY source")
def m7(spark, sf_dir):
    return scores.average_precision(labelled(spark, sf_dir), "n_chars", "quality", ["source"]).select("source", F.col("ap").cast("decimal(18,9)").alias("ap"))


@query("m4_calibration", f"WITH {LABELS}, p AS (SELECT (n_chars % 1001) / 1000.0::DOUBLE AS p, quality FROM l) SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, sum(quality)::BIGINT AS positives, avg(p)::DECIMAL(18,9) AS mean_p FROM p GROUP BY 1")
def m4(spark, sf_dir):
    x = labelled(spark, sf_dir).withColumn("p", (F.col("n_chars") % 1001) / F.lit(1000.0))
    return scores.calibration(x, "p", "quality").select("bin", "n", "positives", F.col("mean_p").cast("decimal(18,9)").alias("mean_p"))


@query("m5_best_f1", "WITH s AS (SELECT n_chars, sum(quality) AS p, count(*) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1), t AS (SELECT n_chars, sum(p) OVER (ORDER BY n_chars DESC) AS tp, sum(c) OVER (ORDER BY n_chars DESC) AS k, sum(p) OVER () AS al FROM s) SELECT n_chars AS threshold, (2 * tp / (k + al)::DOUBLE)::DECIMAL(18,9) AS f1 FROM t ORDER BY 2 * tp / (k + al)::DOUBLE DESC, n_chars DESC LIMIT 1")
def m5(spark, sf_dir):
    return scores.best_f1(labelled(spark, sf_dir), "n_chars", "quality").select("threshold", F.col("f1").cast("decimal(18,9)").alias("f1"))


@query("m10_bh", "WITH p AS (SELECT p_partkey, (p_partkey * 7919 % 10007) / 10007.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p) SELECT p_partkey, least(1, min(p * n / k) OVER (ORDER BY k DESC))::DECIMAL(18,9) AS q FROM r")
def m10(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 10007 / F.lit(10007.0)).alias("p"))
    return scores.adjusted(x, "p").select("p_partkey", F.col("q").cast("decimal(18,9)").alias("q"))


@query("w12_tie_ranks", "SELECT doc_id, source, (2 * rank() OVER (PARTITION BY source ORDER BY n_chars) + count(*) OVER (PARTITION BY source, n_chars) - 1)::BIGINT AS rank2 FROM labels JOIN documents USING (doc_id)")
def w12(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "source", scores.rank_ties("n_chars", "source").cast("long").alias("rank2"))


@query("m8_spearman", "WITH r AS (SELECT source, 2 * rank() OVER (PARTITION BY source ORDER BY n_chars) + count(*) OVER (PARTITION BY source, n_chars) AS a, 2 * rank() OVER (PARTITION BY source ORDER BY doc_id) AS b FROM labels JOIN documents USING (doc_id)) SELECT source, corr(a, b)::DECIMAL(18,8) AS rho FROM r GROUP BY 1")
def m8(spark, sf_dir):
    x = labelled(spark, sf_dir).select("source", scores.rank_ties("n_chars", "source").alias("a"), scores.rank_ties("doc_id", "source").alias("b"))
    return x.groupBy("source").agg(F.corr("a", "b").cast("decimal(18,8)").alias("rho"))


@query("m1_logistic")
def m1(spark, sf_dir):
    x = labelled(spark, sf_dir).withColumn("log_chars", F.log1p("n_chars")).withColumn("label", F.col("quality").cast("double")).withColumn("even", (F.col("doc_id") % 2).cast("double"))
    model = scores.logistic(["log_chars", "even"], "label", x.count()).fit(x)
    return model.transform(x).select("doc_id", F.col("prediction"))


@query("m6_bootstrap")
def m6(spark, sf_dir):
    return scores.bootstrap(table(spark, sf_dir, "events"), "user_id", "value")


def located(spark, sf_dir):
    """Customers at made-up places, by a rule."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", (6 + c * 7919 % 3200 / 100).alias("lat"), (68 + c * 104729 % 3000 / 100).alias("lon"))


@query("g4_hulls")
def g4(spark, sf_dir):
    return geo.hulls(located(spark, sf_dir), "c_nationkey").select("c_nationkey", F.size("ring").alias("corners"))


#: Two scores of labelled documents, 40 clusters, and the weights of 20 replicates, each as the bootstrap draws them.
_MOD = 2_147_483_647
_CUTS = "[" + ", ".join(repr(float(v)) for v in bootstrap._POISSON) + "]::DOUBLE[]"
PAIRED = f"""x AS (SELECT doc_id % 40 AS c, quality::DOUBLE AS y, (n_chars % 97) / 97::DOUBLE AS s0, (doc_id * 31 % 101) / 101::DOUBLE AS s1 FROM labels JOIN documents USING (doc_id)),
q1 AS (SELECT c, r, (c * 48271 + r * 1103515245 % {_MOD} + 12345) % {_MOD} AS v FROM (SELECT DISTINCT c FROM x), range(21) t(r)),
q2 AS (SELECT c, r, v * v % {_MOD} * v % {_MOD} AS v FROM q1), q3 AS (SELECT c, r, (v + v * 69621 % {_MOD} + r * 40692) % {_MOD} AS v FROM q2),
q4 AS (SELECT c, r, v * v % {_MOD} * v % {_MOD} AS v FROM q3),
w AS (SELECT c, r AS replicate, CASE WHEN r = 0 THEN 1 ELSE len(list_filter({_CUTS}, lambda k: k <= v / {_MOD}::DOUBLE)) END::DOUBLE AS w FROM q4),
a AS (SELECT replicate, m, s, sum(w * y) AS h, sum(w) AS n FROM (SELECT c, y, unnest([0, 1]) AS m, unnest([s0, s1]) AS s FROM x) JOIN w USING (c) GROUP BY 1, 2, 3),
b AS (SELECT *, sum(h) OVER (PARTITION BY replicate, m ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY replicate, m ORDER BY s DESC) AS k, sum(h) OVER (PARTITION BY replicate, m) AS p FROM a),
ap AS (SELECT replicate, m, sum(CASE WHEN k > 0 THEN h * tp / k ELSE 0 END) / max(p) AS ap FROM b GROUP BY 1, 2),
br AS (SELECT replicate, sum(w * (s1 - y) ** 2) / sum(w) - sum(w * (s0 - y) ** 2) / sum(w) AS d_brier FROM x JOIN w USING (c) GROUP BY 1),
dl AS (SELECT replicate, max(CASE WHEN m = 1 THEN ap END) - max(CASE WHEN m = 0 THEN ap END) AS d_ap, any_value(d_brier) AS d_brier FROM ap JOIN br USING (replicate) GROUP BY 1)"""


def deltas(spark, sf_dir):
    x = labelled(spark, sf_dir).select((F.col("doc_id") % 40).alias("c"), F.col("quality").alias("y"), (F.col("n_chars") % 97 / 97).alias("s0"), (F.col("doc_id") * 31 % 101 / 101).alias("s1"))
    return bootstrap.paired(x, "c", "y", "s0", "s1", 20)


@query("m6_paired_deltas", f"WITH {PAIRED} SELECT replicate, d_ap::DECIMAL(18,8) AS d_ap, d_brier::DECIMAL(18,8) AS d_brier FROM dl")
def m6_deltas(spark, sf_dir):
    return deltas(spark, sf_dir).select("replicate", *(F.col(c).cast("decimal(18,8)").alias(c) for c in ("d_ap", "d_brier")))


@query("m6_interval", f"WITH {PAIRED} SELECT metric, max(CASE WHEN replicate = 0 THEN d END)::DECIMAL(18,8) AS estimate, quantile_cont(CASE WHEN replicate > 0 THEN d END, 0.025)::DECIMAL(18,8) AS low, quantile_cont(CASE WHEN replicate > 0 THEN d END, 0.975)::DECIMAL(18,8) AS high FROM (SELECT replicate, unnest(['d_ap', 'd_brier']) AS metric, unnest([d_ap, d_brier]) AS d FROM dl) GROUP BY 1")
def m6_range(spark, sf_dir):
    return bootstrap.interval(deltas(spark, sf_dir)).select("metric", *(F.col(c).cast("decimal(18,8)").alias(c) for c in ("estimate", "low", "high")))


#: The hull of a nation's customers of one kind: edges that leave all of them on one side.
HULLS = """lc AS (SELECT c_custkey, c_nationkey, 6 + ((c_custkey * 7919) % 3200) / 100::DOUBLE AS lat, 68 + ((c_custkey * 104729) % 3000) / 100::DOUBLE AS lon FROM customer),
hp AS (SELECT DISTINCT c_nationkey AS ring, lat, lon FROM lc WHERE c_custkey % 3 = 0),
he AS (SELECT a.ring, a.lat AS la, a.lon AS lo, b.lat AS ma, b.lon AS mo FROM hp a JOIN hp b ON a.ring = b.ring AND (a.lat <> b.lat OR a.lon <> b.lon) WHERE NOT EXISTS (SELECT 1 FROM hp p WHERE p.ring = a.ring AND (b.lon - a.lon) * (p.lat - a.lat) - (b.lat - a.lat) * (p.lon - a.lon) < -1e-12))"""
WITHIN = "NOT EXISTS (SELECT 1 FROM he WHERE he.ring = h.ring AND (mo - lo) * (lc.lat - la) - (ma - la) * (lc.lon - lo) < -1e-12)"


def rings(spark, sf_dir):
    x = located(spark, sf_dir).where("c_custkey % 3 = 0").withColumnRenamed("c_nationkey", "nation")
    return geo.hulls(x, "nation").where("size(ring) > 2")


@query("g6_inside", f"WITH {HULLS}, h AS (SELECT ring FROM he GROUP BY ring HAVING count(DISTINCT (la, lo)) > 2) SELECT c_custkey, {WITHIN} AS inside FROM lc JOIN h ON h.ring = lc.c_nationkey")
def g6(spark, sf_dir):
    x = located(spark, sf_dir).join(rings(spark, sf_dir).withColumnRenamed("nation", "c_nationkey"), "c_nationkey")
    return x.select("c_custkey", geo.inside(F.col("lat"), F.col("lon"), F.col("ring")).alias("inside"))


@query("j19_points_in_polygons", f"WITH {HULLS}, h AS (SELECT ring FROM he GROUP BY ring HAVING count(DISTINCT (la, lo)) > 2) SELECT h.ring AS nation, c_custkey FROM lc CROSS JOIN h WHERE {WITHIN}")
def j19(spark, sf_dir):
    return geo.inside_rings(located(spark, sf_dir).select("c_custkey", "lat", "lon"), rings(spark, sf_dir), "ring").select("nation", "c_custkey")
