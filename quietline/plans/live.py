"""Queries of the outage detector, replayed over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import cut, table
from ..streaming import detector
from .registry import query


def messages(spark, sf_dir):
    """Each event is a message of a device, 60 times as fast as it was stamped, so that devices are heard of every ten minutes or so."""
    e = table(spark, sf_dir, "events")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    fast = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60)
    return e.select(F.col("user_id").alias("device"), (F.col("user_id") % 3).alias("provider"), F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + fast).cast("timestamp_ntz").alias("ts"), (F.col("event_type") != "error").alias("up"), "event_id")


FAST = "m AS (SELECT user_id AS device, user_id % 3 AS provider, make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60) AS ts, event_type <> 'error' AS up, event_id FROM events)"


RUNS = f"""{FAST}, k AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY device ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m) WHERE seen IS NULL OR ts > seen),
p AS (SELECT *, max(CASE WHEN up THEN ts END) OVER (w ROWS UNBOUNDED PRECEDING) AS last_up_at, max(CASE WHEN up THEN ts END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, lag(NOT up) OVER w AS failed FROM k WINDOW w AS (PARTITION BY device ORDER BY ts)),
r AS (SELECT *, sum((up AND (prev IS NULL OR failed OR ts - prev >= INTERVAL 10 MINUTE))::INT) OVER (PARTITION BY device ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM p),
c AS (SELECT *, CASE WHEN up THEN min(CASE WHEN up THEN ts END) OVER (PARTITION BY device, run ORDER BY ts ROWS UNBOUNDED PRECEDING) END AS run_start, CASE WHEN up THEN sum(up::INT) OVER (PARTITION BY device, run ORDER BY ts ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS run_count FROM r)"""
#: A run recovers its device when it is 15 minutes old and has 3 successes, unless something breaks it before or just then.
BACK = """bk AS (SELECT device, run_start, last_p AS provider, greatest(run_start + INTERVAL 15 MINUTE, third) AS recovered_at FROM (
  SELECT device, run_start, max(ts) AS last, arg_max(provider, ts) AS last_p, max(CASE WHEN run_count = 3 THEN ts END) AS third, arg_max(fails, ts) AS one, max(CASE WHEN fails IS NOT NULL THEN fails END) AS fails
  FROM (SELECT *, CASE WHEN NOT lead(up) OVER w THEN lead(ts) OVER w END AS fails FROM c WINDOW w AS (PARTITION BY device ORDER BY ts)) WHERE up GROUP BY 1, 2)
  WHERE third IS NOT NULL AND greatest(run_start + INTERVAL 15 MINUTE, third) < least(last + INTERVAL 10 MINUTE, coalesce(fails, last + INTERVAL 1 DAY)))"""


def runs(spark, sf_dir):
    return detector.device_runs(messages(spark, sf_dir), "event_id")


@query("x1_x2_x8_device_runs", f"WITH {RUNS} SELECT device, provider, ts, up, last_up_at, run_start, run_count, coalesce(up AND run_count >= 3 AND ts - run_start >= INTERVAL 15 MINUTE, false) AS recovered FROM c")
def recovered_runs(spark, sf_dir):
    return runs(spark, sf_dir).withColumn("recovered", detector.recovered())


@query("x8_recoveries", f"WITH {RUNS}, {BACK} SELECT device, provider, run_start, recovered_at FROM bk")
def back(spark, sf_dir):
    return detector.recoveries(runs(spark, sf_dir))


END = "2024-01-01 12:00:00"


def watched(spark, sf_dir):
    """(runs, silent devices by tick)."""
    r = cut(runs(spark, sf_dir))
    return r, cut(detector.with_base(detector.silent(r, END), r))


@query("x3_x4_silent", f"""WITH {RUNS}, {BACK},
s AS (SELECT device, provider, ts, lead(ts) OVER (PARTITION BY device ORDER BY ts) AS nxt FROM c WHERE up),
t AS (SELECT s.*, tick FROM s, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '{END}', INTERVAL 5 MINUTE)) AS tick) WHERE tick <= ts + INTERVAL 30 MINUTE AND tick >= ts + INTERVAL 10 MINUTE AND (nxt IS NULL OR tick < nxt)),
f AS (SELECT provider, tick, device, minute(tick) % 10 = 0 AS big, minute(tick) % 15 = 0 AND tick >= ts + INTERVAL 15 MINUTE AS small, ts AS last_up_at, (SELECT min(recovered_at) FROM bk WHERE bk.device = t.device AND bk.run_start > t.ts) AS back_at FROM t)
SELECT f.*, (SELECT count(DISTINCT device) FROM c WHERE up AND c.provider = f.provider AND c.ts <= f.tick AND c.ts >= f.tick - INTERVAL 24 HOUR) AS base FROM f WHERE big OR small""")
def quiet(spark, sf_dir):
    return watched(spark, sf_dir)[1]


@query("x12_mass_pause", f"""WITH {RUNS}, t AS (SELECT unnest(generate_series((SELECT to_timestamp(ceil(epoch(min(ts)) / 300) * 300)::TIMESTAMP FROM c WHERE up), TIMESTAMP '{END}', INTERVAL 5 MINUTE)) AS tick),
n AS (SELECT tick, (SELECT count(DISTINCT device) FROM c WHERE up AND ts <= tick AND ts >= tick - INTERVAL 24 HOUR) AS population, (SELECT count(DISTINCT device) FROM c WHERE up AND ts <= tick AND ts > tick - INTERVAL 10 MINUTE) AS well FROM t)
SELECT tick, population - well AS failing, population, 100 * (population - well) > 30 * population AS paused FROM n WHERE population > 0""")
def pause(spark, sf_dir):
    return detector.paused_ticks(runs(spark, sf_dir)).where(F.col("tick") <= F.lit(END).cast("timestamp_ntz"))


@query("x3_x9_outages")
def found(spark, sf_dir):
    return detector.outages(detector.members(watched(spark, sf_dir)[1], END))


@query("x7_members")
def frozen(spark, sf_dir):
    return detector.members(watched(spark, sf_dir)[1], END)


@query("x10_receipts")
def receipts(spark, sf_dir):
    """A receipt for every provider and tick of the day's first half; those of the last hour come six minutes late."""
    r, q = watched(spark, sf_dir)
    ticks = spark.range(0, 145).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(id * 5))").alias("tick"))
    ticks = ticks.withColumn("evaluated_at", F.when(F.col("tick") > F.lit(END).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR"), F.col("tick") + F.expr("INTERVAL 6 MINUTES")).otherwise(F.col("tick")))
    return detector.receipts(r, ticks, detector.outages(detector.members(q, END)))
