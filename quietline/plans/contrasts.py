"""Contrast queries: paired windows, near and far, freshness, tests, address groups, shapes of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contrasts, geo
from ..sources.tables import table
from .registry import query
from .studies import labelled, located


@query("d21_paired_windows", """WITH e AS (SELECT DISTINCT user_id, ts AS start, ts + INTERVAL 1 HOUR AS stop FROM events WHERE event_type = 'error'),
w AS (SELECT user_id, start, side, start - to_hours(7 + h) AS lo, start - to_hours(1 + h) AS hi FROM e, (VALUES ('case', 0), ('control', 168)) v(side, h)),
f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.user_id = w.user_id AND o.start < w.hi AND o.stop > w.lo)),
c AS (SELECT f.user_id, f.start, count(*) FILTER (side = 'case') AS n_case, count(*) FILTER (side = 'control') AS n_control FROM f JOIN events i ON i.user_id = f.user_id AND i.ts >= f.lo AND i.ts < f.hi GROUP BY 1, 2)
SELECT user_id, start, n_case, n_control FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start DESC) AS k FROM c WHERE n_case >= 1 AND n_control >= 1) WHERE k = 1""")
def d21(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bad = e.where("event_type = 'error'").select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("stop"))
    return contrasts.paired_windows(bad, e, "user_id", "ts", "stop", "ts", least=1)


@query("d22_near_far", """WITH a AS (SELECT user_id, date_trunc('second', max(ts))::TIMESTAMP AS onset FROM events WHERE event_type = 'error' GROUP BY 1),
r AS (SELECT user_id, floor(epoch(onset)) - floor(epoch(ts)) AS lead, round(value * 100)::BIGINT AS cents FROM events JOIN a USING (user_id) WHERE event_type <> 'error' AND ts <= onset)
SELECT user_id, count(*) FILTER (lead <= 86400) AS n_near, count(*) FILTER (lead > 86400) AS n_far, (sum(cents) FILTER (lead <= 86400))::BIGINT AS sum_near, (sum(cents) FILTER (lead > 86400))::BIGINT AS sum_far,
  count(*) FILTER (lead <= 86400) >= 3 AND count(*) FILTER (lead > 86400) >= 9 AS supported FROM r GROUP BY 1""")
def d22(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    onset = e.where("event_type = 'error'").groupBy("user_id").agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz").alias("onset"))
    return contrasts.near_far(e.where("event_type <> 'error'").join(onset, "user_id").where("ts <= onset"), ["user_id"], "onset", "ts", "cents", near_s=86_400)


@query("d24_freshness", """WITH p AS (SELECT event_type, CASE WHEN event_id % 13 > 0 THEN value END AS v, CASE WHEN event_id % 11 > 0 THEN ts - to_hours((event_id % 30 - 2)::INT) END AS stamp, ts FROM events),
s AS (SELECT event_type, CASE WHEN stamp IS NULL THEN 'no_time' WHEN stamp > ts THEN 'future' WHEN ts - stamp > INTERVAL 24 HOUR THEN 'stale' WHEN v IS NULL OR v > 50 THEN 'invalid' ELSE 'fresh' END AS s FROM p)
SELECT event_type, count(*) FILTER (s = 'no_time') AS no_time, count(*) FILTER (s = 'future') AS future, count(*) FILTER (s = 'stale') AS stale, count(*) FILTER (s = 'invalid') AS invalid, count(*) FILTER (s = 'fresh') AS fresh FROM s GROUP BY 1""")
def d24(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    stamp = F.when(i % 11 > 0, F.col("ts") - F.make_dt_interval(F.lit(0), (i % 30 - 2).cast("int")))
    return contrasts.freshness(e, "event_type", F.when(i % 13 > 0, F.col("value")), stamp, F.col("ts"), 24, high=50.0)


@query("m9_signed_ranks", """WITH d AS (SELECT source, n_chars - 1500 AS d FROM labels JOIN documents USING (doc_id) WHERE n_chars <> 1500),
r AS (SELECT source, d, count(*) OVER (PARTITION BY source, abs(d)) AS t, 2 * rank() OVER (PARTITION BY source ORDER BY abs(d)) + count(*) OVER (PARTITION BY source, abs(d)) - 1 AS r FROM d),
g AS (SELECT source, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::BIGINT AS w_plus2, coalesce(sum(r) FILTER (d < 0), 0)::BIGINT AS w_minus2, sum(t * t - 1) AS ties FROM r GROUP BY 1)
SELECT source, n, w_plus2, w_minus2, ((w_plus2 - w_minus2) / (w_plus2 + w_minus2)::DOUBLE)::DECIMAL(18,8) AS rank_biserial, ((w_plus2 / 2.0::DOUBLE - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE))::DECIMAL(18,8) AS z FROM g""")
def m9(spark, sf_dir):
    x = labelled(spark, sf_dir).withColumn("d", F.col("n_chars") - 1500)
    rows = contrasts.signed_ranks(x, "source", "d")
    exact = lambda c: F.col(c).cast("decimal(18,8)").alias(c)
    return rows.select("source", "n", "w_plus2", "w_minus2", exact("rank_biserial"), exact("z"))


def _horner(c, x: str) -> str:
    out = repr(float(c[0])) + "::DOUBLE"
    for k in c[1:]:
        out = f"({out} * {x} + {float(k)!r}::DOUBLE)"
    return out


QUANTILE = f"CASE WHEN abs(p - 0.5) <= 0.47575 THEN (p - 0.5) * {_horner(contrasts._A, '((p - 0.5) * (p - 0.5))')} / {_horner(contrasts._B, '((p - 0.5) * (p - 0.5))')} ELSE sign(0.5 - p) * {_horner(contrasts._C, 'sqrt(-2 * ln(least(p, 1 - p)))')} / {_horner(contrasts._D, 'sqrt(-2 * ln(least(p, 1 - p)))')} END"


@query("m9_shapiro", f"""WITH x AS (SELECT source, n_chars::DOUBLE AS x, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL),
m AS (SELECT source, x, i, n, {QUANTILE} AS m FROM (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM x)),
e AS (SELECT source, n, sqrt(sum(m * m)) AS root, sum(m * m) AS mm, max(m) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2 FROM m GROUP BY 1, 2 HAVING n > 5 AND max(x) > min(x)),
a AS (SELECT *, m1 / root + {_horner((*reversed(contrasts._LAST), 0), '(1 / sqrt(n))')} AS a1, m2 / root + {_horner((*reversed(contrasts._LAST_BUT_ONE), 0), '(1 / sqrt(n))')} AS a2 FROM e),
f AS (SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS phi FROM a)
SELECT source, n, (pow(sum(x * CASE WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 WHEN i = m.n THEN a1 WHEN i = m.n - 1 THEN a2 ELSE m / phi END), 2) / (var_pop(x) * m.n))::DECIMAL(18,8) AS w FROM m JOIN f USING (source, n) GROUP BY source, n""")
def m9_w(spark, sf_dir):
    x = contrasts.shapiro(labelled(spark, sf_dir).where("source IS NOT NULL"), "source", "n_chars", "doc_id")
    return x.where("n > 5").select("source", "n", F.col("w").cast("decimal(18,8)").alias("w"))


@query("m9_t_test", "SELECT source, count(*) AS n, avg(n_chars)::DECIMAL(18,6) AS mean, ((avg(n_chars) - 1500) / stddev_samp(n_chars) * sqrt(count(*)))::DECIMAL(18,6) AS t FROM labels JOIN documents USING (doc_id) GROUP BY 1 HAVING count(*) > 1 AND stddev_samp(n_chars) > 0")
def m9_t(spark, sf_dir):
    x = contrasts.t_tests(labelled(spark, sf_dir), "source", "n_chars", 1500.0)
    return x.where("t IS NOT NULL").select("source", "n", F.col("mean").cast("decimal(18,6)").alias("mean"), F.col("t").cast("decimal(18,6)").alias("t"))


@query("d8_address_groups", """WITH c AS (SELECT c_nationkey, c_custkey, 'h' || c_custkey % 40 AS house, 'r' || c_custkey % 6 AS road, 'l' || c_custkey % 5 AS loc, 0.5 + (c_custkey % 4) * 0.125::DOUBLE AS score FROM customer),
p AS (SELECT c_nationkey, 'HOUSE' AS scope, house AS part, road AS context, score FROM c UNION ALL SELECT c_nationkey, 'HOUSE', house, loc, score FROM c UNION ALL SELECT c_nationkey, 'GALI', road, loc, score FROM c),
s AS (SELECT c_nationkey, scope, part, context, count(*) AS n, sum(score) AS total FROM p GROUP BY ALL HAVING count(*) >= CASE scope WHEN 'HOUSE' THEN 2 ELSE 3 END)
SELECT c_nationkey, scope, part, context, n, round(least(0.9, total / n), 2) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY scope DESC, n DESC, total DESC, part, context) AS k FROM s) WHERE k = 1""")
def d8(spark, sf_dir):
    c = F.col("c_custkey")
    score = 0.5 + (c % 4) * F.lit(0.125)
    entity = lambda kind, letter, n: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(letter), c % n).alias("value"), score.alias("score"))
    kinds = F.inline(F.array(entity("house_details", "h", 40), entity("road", "r", 6), entity("locality", "l", 5)))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", kinds)
    return contrasts.address_groups(rows, "c_nationkey", "c_custkey")


@query("g9_profile")
def g9(spark, sf_dir):
    return geo.profile(located(spark, sf_dir), "c_nationkey")


@query("g5_area")
def g5(spark, sf_dir):
    return geo.hulls(located(spark, sf_dir), "c_nationkey").select("c_nationkey", F.round(geo.area_km2(F.col("ring")), 3).alias("km2"))


@query("g1_hexagons")
def g1(spark, sf_dir):
    return located(spark, sf_dir).select(geo.hexagon(F.col("lat"), F.col("lon"), 20_000.0).alias("h")).groupBy("h.q", "h.r").agg(F.count("*").alias("n"))
