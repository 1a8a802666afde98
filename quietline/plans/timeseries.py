"""Queries over time: the flagship outage map, gaps, episodes, windows, strictly-prior features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import identity, timeline
from ..sources.tables import table
from .registry import query

END = "2024-01-31 00:00:00"

DH = """dh AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, min(ts) AS first_ts, max(ts) AS last_ts,
  sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2)"""
RUN = "run AS (SELECT *, sum((errors > 0)::INT) OVER (PARTITION BY user_id ORDER BY hour ROWS UNBOUNDED PRECEDING)::BIGINT AS bad_so_far FROM dh)"
OK = "ok AS (SELECT e.*, r.bad_so_far FROM events e JOIN run r ON e.user_id = r.user_id AND date_trunc('hour', e.ts) = r.hour WHERE event_type <> 'error')"
GAPS = f"""nx AS (SELECT *, lead(ts) OVER w AS nxt, lead(bad_so_far) OVER w AS nb FROM ok WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
gp AS (SELECT user_id, ts + INTERVAL 1 HOUR AS start, coalesce(nxt, TIMESTAMP '{END}') AS stop, nxt IS NULL AS censored, (floor(epoch(coalesce(nxt, TIMESTAMP '{END}'))) - floor(epoch(ts)))::BIGINT AS seconds, coalesce(nb, bad_so_far) <> bad_so_far AS crossed FROM nx)"""


def events_of(spark, sf_dir):
    return table(spark, sf_dir, "events")


def gaps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_of(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    marked = timeline.bad_hours_so_far(events, F.col("event_type") == "error")
    return timeline.gaps(marked.where("event_type <> 'error'"), END, "1 HOUR", 36_000, carry="bad_so_far")


FLAGSHIP = f"""
WITH {DH}, {RUN}, {OK}, {GAPS},
dev AS (SELECT c_custkey AS user_id, c_nationkey AS cell, TIMESTAMP '2024-01-01' + to_days((c_custkey % 5)::INT) AS since FROM customer WHERE c_custkey IN (SELECT user_id FROM events)),
o AS (SELECT g.*, cell FROM gp g JOIN dev USING (user_id) WHERE seconds >= 36000 AND NOT crossed AND start >= since AND start < since + INTERVAL 25 DAY),
a AS (SELECT cell, count(*) AS outages, count(DISTINCT user_id) AS affected, count(*) FILTER (censored) AS open_outages, median(seconds // 60)::DOUBLE AS median_minutes FROM o GROUP BY cell),
d AS (SELECT cell, count(*) AS devices FROM dev GROUP BY cell HAVING count(*) >= MIN_DEVICES)
SELECT cell::BIGINT AS cell, devices, coalesce(affected, 0) AS affected, coalesce(outages, 0) AS outages, coalesce(open_outages, 0) AS open_outages, median_minutes, coalesce(affected, 0)::DOUBLE / devices AS share
FROM d LEFT JOIN a USING (cell)"""


def gap_map(spark: SparkSession, sf_dir: str, min_devices: int = 5) -> DataFrame:
    """Outages by cell: gaps that cross no bad hour and begin in the device's service, cells with few devices suppressed."""
    events = events_of(spark, sf_dir).select("user_id").distinct()
    since = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 5).cast("int"))
    devices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("cell"), since.alias("since")).join(events, "user_id", "left_semi")
    inside = (F.col("start") >= F.col("since")) & (F.col("start") < F.col("since") + F.expr("INTERVAL 25 DAYS"))
    outages = gaps_of(spark, sf_dir).where("NOT crossed").join(devices, "user_id").where(inside)
    by_cell = outages.groupBy("cell").agg(F.count("*").alias("outages"), F.count_distinct("user_id").alias("affected"), F.count_if("censored").alias("open_outages"), F.median(F.expr("seconds div 60")).alias("median_minutes"))
    total = devices.groupBy("cell").agg(F.count("*").alias("devices")).where(F.col("devices") >= min_devices)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return total.join(by_cell, "cell", "left").select(F.col("cell").cast("long").alias("cell"), "devices", zero("affected"), zero("outages"), zero("open_outages"), "median_minutes", (F.coalesce("affected", F.lit(0)) / F.col("devices")).alias("share"))


@query("flagship_gap_map", FLAGSHIP.replace("MIN_DEVICES", "1"))
def flagship(spark, sf_dir):
    return gap_map(spark, sf_dir, min_devices=1)


@query("a24_gap_map_suppressed", FLAGSHIP.replace("MIN_DEVICES", "5"))
def suppressed(spark, sf_dir):
    return gap_map(spark, sf_dir)


@query("dh_rollup", f"WITH {DH} SELECT * FROM dh")
def dh(spark, sf_dir):
    return timeline.device_hours(events_of(spark, sf_dir))


@query("w4_running_bad", f"WITH {DH}, {RUN} SELECT user_id, hour, bad_so_far FROM run")
def w4(spark, sf_dir):
    return timeline.running_bad(timeline.device_hours(events_of(spark, sf_dir)), F.col("errors") > 0).select("user_id", "hour", "bad_so_far")


@query("w5_w17_w18_gaps", f"WITH {DH}, {RUN}, {OK}, {GAPS} SELECT * FROM gp WHERE seconds >= 36000")
def w17(spark, sf_dir):
    return gaps_of(spark, sf_dir)


@query("w1_latest_row", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w1(spark, sf_dir):
    order = [F.col(c).desc_nulls_last() for c in ("o_orderdate", "o_totalprice", "o_orderkey")]
    return identity.latest(table(spark, sf_dir, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("w7_pseudonyms", "SELECT c_custkey, 'D' || lpad((dense_rank() OVER (ORDER BY sha256(c_custkey::VARCHAR)))::VARCHAR, 6, '0') AS pseudonym FROM (SELECT DISTINCT c_custkey FROM customer)")
def w7(spark, sf_dir):
    return identity.pseudonyms(table(spark, sf_dir, "customer"), "c_custkey")


@query(
    "w9_transitions",
    """SELECT o_custkey, o_orderkey, s IS NOT NULL AND p IS NOT NULL AND s <> p AS changed FROM (
  SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders))""",
)
def w9(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    x = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P"))).withColumn("p", F.last("s", ignorenulls=True).over(w))
    return x.select("o_custkey", "o_orderkey", F.coalesce(F.col("s") != F.col("p"), F.lit(False)).alias("changed"))


@query(
    "w10_rolling_counts",
    "SELECT event_id, "
    + ", ".join(f"(SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND floor(epoch(b.ts)) >= floor(epoch(a.ts)) - {h} * 3600 AND floor(epoch(b.ts)) < floor(epoch(a.ts))) AS n_{h}h" for h in (1, 6, 24))
    + " FROM events a",
)
def w10(spark, sf_dir):
    return timeline.rolling(events_of(spark, sf_dir), (1, 6, 24)).select("event_id", "n_1h", "n_6h", "n_24h")


@query("w11_strongest_window", "SELECT user_id, max(c) AS most FROM (SELECT a.user_id, a.event_id, count(*) AS c FROM events a JOIN events b ON a.user_id = b.user_id AND floor(epoch(b.ts)) BETWEEN floor(epoch(a.ts)) - 21600 AND floor(epoch(a.ts)) GROUP BY ALL) GROUP BY user_id")
def w11(spark, sf_dir):
    return timeline.strongest(events_of(spark, sf_dir), 21_600)


@query(
    "w15_episodes",
    """WITH i AS (SELECT user_id, ts AS start, ts + INTERVAL 1 MINUTE AS stop FROM events WHERE event_type = 'error'),
f AS (SELECT *, CASE WHEN max(stop) OVER w IS NULL OR floor(epoch(start)) - floor(epoch(max(stop) OVER w)) > 21600 THEN 1 ELSE 0 END AS fresh FROM i WINDOW w AS (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM f)
SELECT user_id, episode, min(start) AS start, max(stop) AS stop, count(*) AS n FROM e GROUP BY 1, 2""",
)
def w15(spark, sf_dir):
    errors = events_of(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("stop"))
    return timeline.episodes(errors, 21_600)


@query(
    "w16_anchored_groups",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
r AS (SELECT *, o_orderdate AS anchor FROM o WHERE n = 1 UNION ALL
  SELECT o.*, CASE WHEN epoch(o.o_orderdate) - epoch(r.anchor) > 2592000 THEN o.o_orderdate ELSE r.anchor END FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.n = r.n + 1)
SELECT o_custkey, o_orderdate, o_orderkey, anchor FROM r""",
)
def w16(spark, sf_dir):
    return timeline.anchored(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 30 * 86_400)


@query(
    "j5_spine_cross",
    """SELECT n_nationkey::BIGINT AS n_nationkey, day, count(e.event_id) AS n FROM nation CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS day) s
LEFT JOIN (SELECT event_id, c_nationkey, date_trunc('day', ts) AS d FROM events JOIN customer ON c_custkey = user_id) e ON e.c_nationkey = n_nationkey AND e.d = s.day GROUP BY 1, 2""",
)
def j5(spark, sf_dir):
    cells = timeline.spine(table(spark, sf_dir, "nation").select("n_nationkey"), "2024-01-01", "2024-01-30", "1 DAY", "day")
    e = events_of(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("user_id")).groupBy(F.col("c_nationkey").alias("n_nationkey"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return cells.join(e, ["n_nationkey", "day"], "left").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "day", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "j6_interval_overlap",
    """WITH i AS (SELECT o_custkey, o_orderdate AS start, o_orderdate + to_minutes((1 + o_orderkey * 37 % 4000)::INT) AS stop FROM orders),
d AS (SELECT o_custkey, unnest(generate_series(date_trunc('day', start)::TIMESTAMP, date_trunc('day', stop - INTERVAL 1 SECOND)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM i)
SELECT day, count(*) AS open_orders, count(DISTINCT o_custkey) AS customers FROM d GROUP BY day""",
)
def j6(spark, sf_dir):
    i = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.make_dt_interval(mins=(1 + F.col("o_orderkey") * 37 % 4000).cast("int"))).alias("stop"))
    return timeline.over_days(i).groupBy("day").agg(F.count("*").alias("open_orders"), F.count_distinct("o_custkey").alias("customers"))


ANCHORS = "an AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-29', INTERVAL 3 HOUR)) AS anchor FROM (SELECT DISTINCT user_id FROM events))"


def anchors_of(spark, sf_dir):
    return timeline.spine(events_of(spark, sf_dir).select("user_id").distinct(), "2024-01-02", "2024-01-29", "3 HOURS", "anchor")


@query(
    "j7_trailing_visible",
    f"""WITH {ANCHORS}, v AS (SELECT *, ts + to_minutes((event_id % 90)::INT) AS seen_at FROM events)
SELECT an.user_id, anchor, count(event_id) AS n, coalesce(sum(round(value * 100)::BIGINT), 0)::BIGINT AS cents FROM an LEFT JOIN v ON v.user_id = an.user_id AND ts > anchor - INTERVAL 6 HOUR AND ts <= anchor AND seen_at <= anchor GROUP BY 1, 2""",
)
def j7(spark, sf_dir):
    """Events of the trailing 6 hours that were there to see at the anchor: each event goes to the two or three anchors it may serve."""
    v = events_of(spark, sf_dir).withColumn("seen_at", F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int")))
    first = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.expr("hour(ts) div 3") * 3).cast("int"))
    v = v.withColumn("anchor", F.explode(F.sequence(first, first + F.expr("INTERVAL 9 HOURS"), F.expr("INTERVAL 3 HOURS")))).where("ts > anchor - INTERVAL 6 HOURS AND ts <= anchor AND seen_at <= anchor")
    hit = v.groupBy("user_id", "anchor").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return anchors_of(spark, sf_dir).join(hit, ["user_id", "anchor"], "left").select("user_id", "anchor", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cents", F.lit(0)).alias("cents"))


@query(
    "j8_strict_prior",
    f"""WITH {ANCHORS}, m AS (SELECT an.user_id, anchor, max({{'t': ts, 'i': event_id, 'v': event_type}}) AS p FROM an LEFT JOIN events e ON e.user_id = an.user_id AND ts < anchor AND floor(epoch(anchor)) - floor(epoch(ts)) <= 86400 GROUP BY 1, 2)
SELECT user_id, anchor, p.v AS prior_value, p.t AS prior_at FROM m""",
)
def j8(spark, sf_dir):
    return timeline.strictly_prior(anchors_of(spark, sf_dir), events_of(spark, sf_dir), "user_id", "anchor", "ts", "event_type", 86_400)


@query(
    "j9_p23_guarded_labels",
    f"""WITH {ANCHORS}, l AS (SELECT an.user_id, anchor, min(ts) FILTER (ts > anchor) AS nxt FROM an LEFT JOIN events e ON e.user_id = an.user_id AND e.event_type = 'error' GROUP BY 1, 2)
SELECT user_id, anchor, coalesce(nxt > anchor + INTERVAL 2 HOUR AND nxt <= anchor + INTERVAL 6 HOUR, false) AS label FROM l WHERE nxt IS NULL OR nxt > anchor + INTERVAL 2 HOUR""",
)
def j9(spark, sf_dir):
    """Next failure after each anchor, on one timeline; anchors with one within the guard are out."""
    errors = events_of(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("ts").alias("t"), F.lit(True).alias("hit"))
    both = anchors_of(spark, sf_dir).select("user_id", F.col("anchor").alias("t"), F.lit(False).alias("hit")).unionByName(errors)
    w = Window.partitionBy("user_id").orderBy(F.col("t"), F.col("hit").desc()).rowsBetween(1, Window.unboundedFollowing)
    x = both.withColumn("nxt", F.first(F.when(F.col("hit"), F.col("t")), ignorenulls=True).over(w)).where("NOT hit AND (nxt IS NULL OR nxt > t + INTERVAL 2 HOURS)")
    return x.select("user_id", F.col("t").alias("anchor"), F.coalesce(F.expr("nxt <= t + INTERVAL 6 HOURS"), F.lit(False)).alias("label"))


@query("j12_not_exists", "SELECT event_id FROM events a WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 60 MINUTE)")
def j12(spark, sf_dir):
    """The previous distinct time takes the place of an anti-join over a range."""
    e = events_of(spark, sf_dir).where("event_type = 'error'")
    w = Window.partitionBy("user_id").orderBy("ts")
    before = e.select("user_id", "ts").distinct().withColumn("p", F.lag("ts").over(w))
    return e.join(before, ["user_id", "ts"]).where("p IS NULL OR p < ts - INTERVAL 60 MINUTES").select("event_id")


@query("j14_three_hours", f"WITH {DH} SELECT c.user_id, c.hour, coalesce(p.n, 0) AS n_before, c.n, coalesce(x.n, 0) AS n_after FROM dh c LEFT JOIN dh p ON p.user_id = c.user_id AND p.hour = c.hour - INTERVAL 1 HOUR LEFT JOIN dh x ON x.user_id = c.user_id AND x.hour = c.hour + INTERVAL 1 HOUR")
def j14(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("hour")
    x = timeline.device_hours(events_of(spark, sf_dir)).withColumns({"ph": F.lag("hour").over(w), "pn": F.lag("n").over(w), "xh": F.lead("hour").over(w), "xn": F.lead("n").over(w)})
    one = F.expr("INTERVAL 1 HOUR")
    return x.select("user_id", "hour", F.when(F.col("ph") == F.col("hour") - one, F.col("pn")).otherwise(0).alias("n_before"), "n", F.when(F.col("xh") == F.col("hour") + one, F.col("xn")).otherwise(0).alias("n_after"))


@query("p15_right_bins", "WITH g AS (SELECT (floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))))::BIGINT // 60 AS m FROM events) SELECT CASE WHEN m IS NULL THEN 'missing' WHEN m <= 0 THEN 'out' WHEN m <= 60 THEN '(0,60]' WHEN m <= 180 THEN '(60,180]' WHEN m <= 360 THEN '(180,360]' WHEN m <= 720 THEN '(360,720]' WHEN m <= 1440 THEN '(720,1440]' ELSE 'out' END AS bin, count(*) AS n FROM g GROUP BY 1")
def p15(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = events_of(spark, sf_dir).withColumn("p", F.lag("ts").over(w)).select(((timeline.seconds("ts") - timeline.seconds("p")) / 60).cast("long").alias("m"))
    bins = F.when(F.col("m").isNull(), "missing").when(F.col("m") <= 0, "out")
    for lo, hi in ((0, 60), (60, 180), (180, 360), (360, 720), (720, 1440)):
        bins = bins.when(F.col("m") <= hi, f"({lo},{hi}]")
    return m.groupBy(bins.otherwise("out").alias("bin")).agg(F.count("*").alias("n"))


@query("p17_splits", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-18 23:00:00' THEN 'train' WHEN ts >= TIMESTAMP '2024-01-19 01:00:00' AND ts < TIMESTAMP '2024-01-24 23:00:00' THEN 'validation' WHEN ts >= TIMESTAMP '2024-01-25 01:00:00' THEN 'test' ELSE 'purged' END AS split, count(*) AS n, count(DISTINCT user_id) AS devices FROM events GROUP BY 1")
def p17(spark, sf_dir):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    split = F.when(F.col("ts") < at("2024-01-18 23:00:00"), "train").when((F.col("ts") >= at("2024-01-19 01:00:00")) & (F.col("ts") < at("2024-01-24 23:00:00")), "validation").when(F.col("ts") >= at("2024-01-25 01:00:00"), "test").otherwise("purged")
    return events_of(spark, sf_dir).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("devices"))


@query("a7_bit_words", "WITH h AS (SELECT user_id, (epoch(date_trunc('hour', ts)) - epoch(TIMESTAMP '2024-01-01'))::BIGINT // 3600 AS o FROM events WHERE event_type <> 'error') SELECT user_id, " + ", ".join(f"coalesce(bit_or(1::BIGINT << (o % 60)::INT) FILTER (o // 60 = {k}), 0)::BIGINT AS w{k}" for k in range(12)) + " FROM h GROUP BY user_id")
def a7(spark, sf_dir):
    return bit_words(spark, sf_dir)


def bit_words(spark, sf_dir) -> DataFrame:
    """Hours with a success as bits of twelve 60-bit words."""
    o = F.expr("(unix_timestamp(cast(date_trunc('hour', ts) as timestamp)) - 1704067200) div 3600")
    x = events_of(spark, sf_dir).where("event_type <> 'error'").select("user_id", o.alias("o"))
    return x.groupBy("user_id").agg(*(F.bit_or(F.when(F.expr(f"o div 60 = {k}"), F.expr("shiftleft(1L, cast(o % 60 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(12)))


@query("j23_bit_test", "SELECT user_id, bool_or(event_type <> 'error' AND date_trunc('hour', ts) = TIMESTAMP '2024-01-10 06:00:00') AS up FROM events GROUP BY user_id HAVING bool_or(event_type <> 'error')")
def j23(spark, sf_dir):
    hour = 9 * 24 + 6
    return bit_words(spark, sf_dir).select("user_id", (F.shiftright(f"w{hour // 60}", hour % 60).bitwiseAND(F.lit(1)) == 1).alias("up"))


@query("a12_half_period", "SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'early' ELSE 'late' END AS half, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def a12(spark, sf_dir):
    half = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "early").otherwise("late")
    return events_of(spark, sf_dir).groupBy("user_id", half.alias("half")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
