"""Queries over hourly telemetry that a rule makes of the customers: validity, repair, states, triggers, cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hours as h
from ..sources.tables import table
from .registry import query

#: One row a customer and hour of a day, by a rule: some end wrongly, some contradict themselves.
ROWS_SQL = """r AS (SELECT c_custkey AS device, i AS k, TIMESTAMP '2024-01-05 00:00:00' + i * INTERVAL 1 HOUR AS hour, (c_custkey * 31 + i * 17) % 53 AS m, (c_custkey * 7 + i) % 13 AS n FROM customer, range(24) t(i)),
rows_ AS (SELECT device, hour,
  CASE WHEN m = 1 THEN hour + INTERVAL 2 HOUR WHEN m = 2 THEN NULL WHEN k = 23 AND device % 2 = 0 THEN date_trunc('day', hour) ELSE hour + INTERVAL 1 HOUR END AS hour_end,
  CASE WHEN m = 3 THEN NULL WHEN m = 4 THEN -1 ELSE n END AS received,
  CASE WHEN n = 0 AND m <> 5 OR m = 6 THEN NULL WHEN m = 7 THEN hour - INTERVAL 1 MINUTE WHEN m = 8 THEN hour + INTERVAL 1 HOUR ELSE hour + (n % 5) * INTERVAL 1 MINUTE END AS first_at,
  CASE WHEN n = 0 AND m <> 5 THEN NULL WHEN m = 9 THEN hour - INTERVAL 1 SECOND WHEN m = 10 THEN hour + INTERVAL 1 HOUR ELSE hour + (20 + n) * INTERVAL 1 MINUTE END AS last_at FROM r),
e AS (SELECT *, CASE WHEN hour_end = hour + INTERVAL 1 HOUR OR (hour(hour) = 23 AND hour_end = date_trunc('day', hour)) THEN hour + INTERVAL 1 HOUR END AS ends FROM rows_)"""
INVALID_SQL = "coalesce(ends IS NULL OR received IS NULL OR received < 0 OR (received = 0 AND (first_at IS NOT NULL OR last_at IS NOT NULL)) OR (received > 0 AND (first_at IS NULL OR last_at IS NULL OR first_at < hour OR first_at >= ends OR last_at < first_at OR last_at >= ends)), true)"


def hour_rows(spark, sf_dir):
    i, day = F.col("k"), F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("k"))
    x = x.withColumns({"hour": day + F.make_dt_interval(hours=i), "m": (F.col("device") * 31 + i * 17) % 53, "n": (F.col("device") * 7 + i) % 13})
    m, n, hour = F.col("m"), F.col("n"), F.col("hour")
    mins = lambda c: hour + F.make_dt_interval(mins=c.cast("int"))
    end = F.when(m == 1, h.later("hour", 2)).when(m == 2, None).when((i == 23) & (F.col("device") % 2 == 0), F.date_trunc("day", "hour").cast("timestamp_ntz")).otherwise(h.later("hour", 1))
    none = (n == 0) & (m != 5)
    first = F.when(none | (m == 6), None).when(m == 7, h.later("hour", 0, -1)).when(m == 8, h.later("hour", 1)).otherwise(mins(n % 5))
    last = F.when(none, None).when(m == 9, hour - F.expr("INTERVAL 1 SECOND")).when(m == 10, h.later("hour", 1)).otherwise(mins(n + 20))
    received = F.when(m == 3, None).when(m == 4, -1).otherwise(n)
    return x.select("device", "hour", end.alias("hour_end"), received.alias("received"), first.alias("first_at"), last.alias("last_at"))


@query("p7_effective_hour", f"WITH {ROWS_SQL} SELECT device, hour, ends FROM e")
def p7(spark, sf_dir):
    return hour_rows(spark, sf_dir).select("device", "hour", h.effective_end("hour", "hour_end").alias("ends"))


@query("p8_valid_hours", f"WITH {ROWS_SQL} SELECT device, count(*) AS n, count(*) FILTER ({INVALID_SQL}) AS invalid_rows, count(*) FILTER (ends IS NULL) AS without_end FROM e GROUP BY device")
def p8(spark, sf_dir):
    x = hour_rows(spark, sf_dir).withColumn("ends", h.effective_end("hour", "hour_end"))
    bad = h.invalid("received", "first_at", "last_at", "hour", F.col("ends"))
    return x.groupBy("device").agg(F.count("*").alias("n"), F.count_if(bad).alias("invalid_rows"), F.count_if(F.col("ends").isNull()).alias("without_end"))


@query("p6_optical_validity", "SELECT p_partkey, CASE WHEN a >= -50 AND a <= m AND m <= b AND b < 0 THEN m END AS power FROM (SELECT p_partkey, -(p_size + p_partkey % 9)::DOUBLE AS a, -(p_size - p_partkey % 4)::DOUBLE AS m, -(p_size - 5)::DOUBLE AS b FROM part)")
def p6(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    x = table(spark, sf_dir, "part").select("p_partkey", (-(s + k % 9)).cast("double").alias("a"), (-(s - k % 4)).cast("double").alias("m"), (-(s - 5)).cast("double").alias("b"))
    return x.select("p_partkey", h.optics("a", "m", "b").alias("power"))


#: Bitmaps of a day and a half by a rule: areas that fail for 90 minutes, single misses, absent hours, bad hours.
HOURS_SQL = """c AS (SELECT c_custkey AS device, (c_custkey % 12)::BIGINT AS cell FROM customer),
s AS (SELECT device, cell, i, TIMESTAMP '2024-01-05 00:00:00' + i * INTERVAL 1 HOUR AS hour,
  list_aggregate([CASE WHEN ((cell * 13 + ((i * 12 + k + cell * 5) // 24) * 7) % 11 = 0 AND device % 10 < 5 + (cell + (i // 6)) % 4) OR ((device * 7919 + (i * 12 + k) * 1049) % 29 = 0) THEN '0' ELSE '1' END FOR k IN range(12)], 'string_agg', '') AS bitmap,
  CASE WHEN (device * 31 + i * 7) % 1511 = 0 AND cell % 3 = 0 THEN 1 ELSE 0 END AS bad FROM c, range(36) t(i)),
d AS (SELECT c.device, c.cell, TIMESTAMP '2024-01-05 00:00:00' + g.i * INTERVAL 1 HOUR AS hour, coalesce(s.bitmap, '000000000000') AS bitmap, coalesce(s.bad, 0) AS bad
  FROM c CROSS JOIN range(36) g(i) LEFT JOIN (SELECT * FROM s WHERE (device + i) % 37 <> 0) s ON s.device = c.device AND s.i = g.i)"""
QUARTERS_SQL = """l AS (SELECT *, lag(bitmap) OVER w AS pb, lag(bad) OVER w AS pbad, lead(bitmap) OVER w AS nb, lead(bad) OVER w AS nbad FROM d WINDOW w AS (PARTITION BY device ORDER BY hour)),
q AS (SELECT device, cell, hour, hour + (15 * (q + 1)) * INTERVAL 1 MINUTE AS anchor, substr(bitmap, 3 * q + 1, 3) = '000' AND substr(pb || bitmap, 3 * q + 4, 12) <> '000000000000' AS early, substr(pb || bitmap, 3 * q + 4, 12) = '000000000000' AS outage, CASE WHEN q = 3 THEN bad ELSE greatest(pbad, bad) END AS state_bad FROM l, (VALUES (0), (1), (2), (3)) v(q) WHERE pb IS NOT NULL),
cs AS (SELECT cell, anchor, count(*) AS eligible, count(*) FILTER (early) AS early, count(*) FILTER (outage) AS outage, count(*) FILTER (state_bad = 1) AS bad FROM q GROUP BY 1, 2 HAVING count(*) >= 20),
raw AS (SELECT *, bad = 0 AND early >= ceil(eligible / 10.0) AND outage < ceil(eligible / 10.0) AS hit FROM cs),
tr AS (SELECT cell, anchor, eligible, early, outage, bad FROM raw t WHERE hit AND NOT EXISTS (SELECT 1 FROM raw p WHERE p.cell = t.cell AND p.hit AND p.anchor >= t.anchor - INTERVAL 60 MINUTE AND p.anchor < t.anchor))"""
CASCADE_SQL = """f AS (SELECT t.cell, t.anchor, t.eligible, k, count(*) AS seen, max(greatest(l.pbad, l.bad, l.nbad)) AS bad, count(*) FILTER (substr(l.pb || l.bitmap || l.nb, (1 + minute(t.anchor) // 5 + k)::INT, 12) = '000000000000') AS out
  FROM tr t JOIN l ON l.cell = t.cell AND l.hour = date_trunc('hour', t.anchor) AND l.pb IS NOT NULL AND l.nb IS NOT NULL, range(1, 13) v(k) GROUP BY 1, 2, 3, 4)
SELECT cell, anchor, eligible, max(out * 10 >= eligible * 7) AS cascade, min(CASE WHEN out * 10 >= eligible * 7 THEN k * 5 END)::INT AS warning_minutes FROM f GROUP BY 1, 2, 3 HAVING count(*) = 12 AND min(seen) = eligible AND max(seen) = eligible AND max(bad) = 0"""


def roster(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device"), (F.col("c_custkey") % 12).alias("cell"))


def bitmaps(spark, sf_dir):
    d, c, i = F.col("device"), F.col("cell"), F.col("i")
    x = roster(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(35).cast("long"))))

    def slot(k):
        at = i * 12 + k
        area = (c * 13 + F.floor((at + c * 5) / 24) * 7) % 11 == 0
        hit = (area & (d % 10 < 5 + (c + F.floor(i / 6)) % 4)) | ((d * 7919 + at * 1049) % 29 == 0)
        return F.when(hit, "0").otherwise("1")

    hour = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=i.cast("int"))
    bad = F.when(((d * 31 + i * 7) % 1511 == 0) & (c % 3 == 0), 1).otherwise(0)
    made = x.select("device", hour.alias("hour"), F.concat(*map(slot, range(12))).alias("bitmap"), bad.alias("bad"), ((d + i) % 37 != 0).alias("there")).where("there")
    return h.with_misses(roster(spark, sf_dir), made, "2024-01-05 00:00:00", "2024-01-06 11:00:00")


@query("d20_absent_hours", f"WITH {HOURS_SQL} SELECT device, count(*) AS hours, count(*) FILTER (bitmap = '000000000000') AS missed, sum(bad)::BIGINT AS bad FROM d GROUP BY device")
def d20(spark, sf_dir):
    x = bitmaps(spark, sf_dir).groupBy("device")
    return x.agg(F.count("*").alias("hours"), F.count_if(F.col("bitmap") == h.MISSED).alias("missed"), F.sum("bad").cast("long").alias("bad"))


@query("d17_quarter_state", f"WITH {HOURS_SQL}, {QUARTERS_SQL} SELECT device, count(*) AS n, count(*) FILTER (early) AS early, count(*) FILTER (outage) AS outage, min(CASE WHEN outage THEN anchor END) AS first_outage FROM q GROUP BY device")
def d17(spark, sf_dir):
    x = h.quarter_states(bitmaps(spark, sf_dir)).groupBy("device")
    return x.agg(F.count("*").alias("n"), F.count_if("early").alias("early"), F.count_if("outage").alias("outage"), F.min(F.when(F.col("outage"), F.col("anchor"))).alias("first_outage"))


@query("d17_cell_state", f"WITH {HOURS_SQL}, {QUARTERS_SQL} SELECT * FROM cs")
def d17_cells(spark, sf_dir):
    return h.cell_states(h.quarter_states(bitmaps(spark, sf_dir)))


@query("d18_cell_triggers", f"WITH {HOURS_SQL}, {QUARTERS_SQL} SELECT * FROM tr")
def d18(spark, sf_dir):
    return h.triggers(d17_cells(spark, sf_dir))


@query("d19_cascade_label", f"WITH {HOURS_SQL}, {QUARTERS_SQL}, {CASCADE_SQL}")
def d19(spark, sf_dir):
    return h.cascades(d18(spark, sf_dir), bitmaps(spark, sf_dir))
