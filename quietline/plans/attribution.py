"""Attribution queries: states, gates, cells and ordered rules, on analogues of providers (segments) and cells (nations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution, rules
from ..operators.timeline import seconds
from ..sources import feeds, tables
from ..sources.tables import table
from .registry import query

LAST = "ls AS (SELECT c_custkey, c_mktsegment AS csp, c_nationkey::BIGINT AS cell, floor(epoch(TIMESTAMP '2024-01-30 12:00:00'))::BIGINT - floor(epoch(t))::BIGINT AS age FROM customer LEFT JOIN (SELECT user_id, max(ts) AS t FROM events WHERE event_type <> 'error' GROUP BY 1) ON user_id = c_custkey)"
STATE = "st AS (SELECT *, CASE WHEN age IS NULL OR age < 0 THEN 'UNKNOWN' WHEN age >= 43200 THEN 'DOWN' ELSE 'UP' END AS state FROM ls)"
CELLS = "cs AS (SELECT csp, cell, count(*) AS n, count(*) FILTER (state = 'DOWN') AS down, CASE WHEN count(*) FILTER (state = 'DOWN') * 1000 >= count(*) * 700 THEN 'DOWN' ELSE 'UP' END AS state FROM st WHERE age IS NOT NULL GROUP BY 1, 2)"


def states(spark, sf_dir):
    last = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("t"))
    age = seconds(F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")) - seconds("t")
    x = table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", F.col("c_mktsegment").alias("csp"), F.col("c_nationkey").cast("long").alias("cell"), age.alias("age"))
    return x.withColumn("state", rules.device_state(F.col("age"), 43_200))


@query("d4_device_state", f"WITH {LAST}, {STATE} SELECT c_custkey, state FROM st")
def d4(spark, sf_dir):
    return states(spark, sf_dir).select("c_custkey", "state")


def cells(spark, sf_dir):
    return rules.cell_states(states(spark, sf_dir).where("age IS NOT NULL").withColumn("hit", F.col("state") == "DOWN"), "csp", "cell", "hit")


@query("d11_cell_states", f"WITH {LAST}, {STATE}, {CELLS} SELECT * FROM cs")
def d11(spark, sf_dir):
    return cells(spark, sf_dir)


@query("j21_relevant_cells", "WITH a AS (SELECT DISTINCT c_mktsegment AS csp, c_nationkey AS cell FROM customer JOIN events ON user_id = c_custkey AND event_type = 'error' AND ts < TIMESTAMP '2024-01-01 12:00:00'), p AS (SELECT DISTINCT c_mktsegment AS csp, c_nationkey AS cell FROM customer) SELECT csp, cell::BIGINT AS cell FROM p WHERE csp IN (SELECT csp FROM a) UNION SELECT csp, cell FROM p WHERE cell IN (SELECT cell FROM a)")
def j21(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("csp"), F.col("c_nationkey").cast("long").alias("cell"))
    hit = table(spark, sf_dir, "events").where("event_type = 'error' AND ts < timestamp_ntz'2024-01-01 12:00:00'")
    a, every = p.join(hit, "user_id", "left_semi").select("csp", "cell").distinct(), p.select("csp", "cell").distinct()
    return every.join(a, "csp", "left_semi").union(every.join(a, "cell", "left_semi").select("csp", "cell")).distinct()


#: Batch: a fleet of the customers that events know, providers by segment and nation, cells that they share (but one has its own).
#: A provider's outage is the devices with an error between two days, in spans that grow.
FLEET = """fl AS (
  SELECT c_custkey AS device, c_mktsegment || (c_nationkey % 3) AS csp,
    CASE WHEN c_custkey % 13 = 4 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'm' || (c_nationkey % 3) ELSE 'h' || (c_nationkey // 6) END AS cell,
    CASE WHEN c_custkey % 17 <> 3 THEN 20 + (c_nationkey // 6) * 0.05::DOUBLE + (c_custkey % 10) * 0.01::DOUBLE END AS lat,
    CASE WHEN c_custkey % 17 <> 3 THEN 77 + (c_nationkey % 6) * 0.02::DOUBLE + ((c_custkey // 10) % 10) * 0.01::DOUBLE END AS lon, c_custkey % 11 <> 5 AS active
  FROM customer WHERE c_custkey <= (SELECT max(user_id) FROM events))"""
OUTAGES = """f1 AS (SELECT user_id AS device, floor(sqrt(day(ts) - 1))::INT AS bin, min(ts) AS t FROM events WHERE event_type = 'error' GROUP BY 1, 2),
me AS (SELECT fl.*, csp || ':' || bin AS outage, t FROM f1 JOIN fl USING (device)),
ou AS (SELECT outage, csp, date_trunc('second', min(t)) AS trig FROM me GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY trig, outage) AS n FROM ou),
r AS (SELECT *, trig AS anchor, 1 AS e FROM o WHERE n = 1 UNION ALL
  SELECT o.*, CASE WHEN epoch(o.trig) - epoch(r.anchor) > 21600 THEN o.trig ELSE r.anchor END, CASE WHEN epoch(o.trig) - epoch(r.anchor) > 21600 THEN r.e + 1 ELSE r.e END FROM r JOIN o ON o.n = r.n + 1)"""
#: Written from the rules: each outage asks its own sets.
CHAIN = """hi AS (SELECT r.e, me.* FROM me JOIN r USING (outage)),
fc AS (SELECT csp, cell, count(*) AS n FROM fl WHERE active AND cell IS NOT NULL GROUP BY 1, 2),
ac AS (SELECT e, csp, cell, count(DISTINCT device) AS failed, count(DISTINCT CASE WHEN NOT active THEN device END) AS extra FROM hi WHERE cell IS NOT NULL GROUP BY 1, 2, 3),
rl AS (SELECT e, csp, cell FROM ac UNION SELECT h.e, fc.csp, fc.cell FROM hi h JOIN fc ON fc.csp = h.csp UNION SELECT ac.e, fc.csp, fc.cell FROM ac JOIN fc ON fc.cell = ac.cell),
st AS (SELECT rl.*, coalesce(failed, 0) AS failed, coalesce(n, 0) + coalesce(extra, 0) AS eligible FROM rl LEFT JOIN ac ON ac.e = rl.e AND ac.csp = rl.csp AND ac.cell = rl.cell LEFT JOIN fc ON fc.csp = rl.csp AND fc.cell = rl.cell),
dn AS (SELECT * FROM st WHERE 10 * failed >= 7 * eligible),
pt AS (SELECT DISTINCT outage, lat, lon FROM me WHERE lat IS NOT NULL),
ed AS (SELECT a.outage, a.lat AS la, a.lon AS lo, b.lat AS ma, b.lon AS mo FROM pt a JOIN pt b ON a.outage = b.outage AND (a.lat <> b.lat OR a.lon <> b.lon)
  WHERE NOT EXISTS (SELECT 1 FROM pt p WHERE p.outage = a.outage AND (b.lon - a.lon) * (p.lat - a.lat) - (b.lat - a.lat) * (p.lon - a.lon) < -1e-12)),
po AS (SELECT DISTINCT ed.outage FROM ed JOIN pt p ON p.outage = ed.outage AND (mo - lo) * (p.lat - la) - (ma - la) * (p.lon - lo) > 1e-12),
fp AS (SELECT * FROM fl WHERE active AND cell IS NOT NULL AND lat IS NOT NULL),
ns AS (SELECT r.outage, r.e, r.csp AS own, fp.device, fp.csp FROM r JOIN po USING (outage) CROSS JOIN fp
  WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.outage = r.outage AND (mo - lo) * (fp.lat - la) - (ma - la) * (fp.lon - lo) < -1e-12)),
pe AS (SELECT ns.outage, count(*) FILTER (ns.csp <> own) > 0 AS others, count(*) FILTER (ns.csp <> own AND EXISTS (SELECT 1 FROM hi WHERE hi.e = ns.e AND hi.device = ns.device)) > 0 AS others_down FROM ns GROUP BY 1),
ca AS (SELECT r.outage, r.e, r.csp, s.cell, s.failed, s.eligible, (SELECT count(*) FROM dn WHERE dn.e = r.e AND dn.cell = s.cell) AS here FROM r JOIN st s ON s.e = r.e AND s.csp = r.csp
  WHERE CASE WHEN EXISTS (SELECT 1 FROM dn WHERE dn.e = r.e AND dn.csp = r.csp) THEN 10 * s.failed >= 7 * s.eligible ELSE EXISTS (SELECT 1 FROM me WHERE me.outage = r.outage AND me.cell = s.cell) END),
tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outage ORDER BY here DESC, failed::DOUBLE / eligible DESC, cell) AS k FROM ca) WHERE k = 1),
fx AS (SELECT r.outage, r.e, r.csp, tg.cell, tg.failed, tg.eligible,
  EXISTS (SELECT 1 FROM po WHERE po.outage = r.outage) AS poly, coalesce(pe.others, false) AS others, coalesce(pe.others_down, false) AS others_down,
  (SELECT count(DISTINCT device) FROM hi WHERE hi.e = r.e AND hi.csp = r.csp AND active AND hi.cell IS NOT NULL) AS dd, (SELECT coalesce(sum(n), 0)::BIGINT FROM fc WHERE fc.csp = r.csp) AS de,
  EXISTS (SELECT 1 FROM me WHERE me.outage = r.outage AND me.cell IS NOT NULL) AS located,
  (SELECT count(*) FROM dn WHERE dn.e = r.e AND dn.csp = r.csp) AS n_down, (SELECT count(*) FROM fc WHERE fc.csp = r.csp) AS n_cells,
  (SELECT count(*) FROM dn WHERE dn.e = r.e AND dn.cell = tg.cell) AS here,
  NOT EXISTS (SELECT 1 FROM dn WHERE dn.e = r.e AND dn.cell = tg.cell AND (SELECT count(*) FROM fc WHERE fc.csp = dn.csp) < 2) AS wide,
  NOT EXISTS (SELECT 1 FROM dn WHERE dn.e = r.e AND dn.cell = tg.cell AND NOT EXISTS (SELECT 1 FROM dn x WHERE x.e = dn.e AND x.csp = dn.csp AND x.cell <> dn.cell)) AS elsewhere,
  EXISTS (SELECT 1 FROM fc WHERE fc.cell = tg.cell AND fc.csp <> r.csp) AS near, (SELECT count(*) FROM fc WHERE fc.cell = tg.cell) AS compared,
  EXISTS (SELECT 1 FROM fc JOIN st ON st.e = r.e AND st.csp = fc.csp AND st.cell = fc.cell WHERE fc.cell = tg.cell AND fc.csp <> r.csp AND 10 * st.failed < 7 * st.eligible) AS near_up,
  NOT EXISTS (SELECT 1 FROM dn WHERE dn.e = r.e AND dn.csp = r.csp AND 10 * failed <= 7 * dn.eligible) AS above
  FROM r LEFT JOIN tg ON tg.outage = r.outage LEFT JOIN pe ON pe.outage = r.outage),
ru AS (SELECT *, CASE WHEN NOT poly THEN 'R0_GEOMETRY_QUALITY_FAILURE' WHEN de > 0 AND 10 * dd >= 8 * de THEN 'R0_CSP_DOWN_SHARE' WHEN others AND NOT others_down THEN 'R0_POLYGON_PEER_UP' WHEN NOT located THEN 'R0_NO_LOCATED_H3'
  WHEN n_down = 0 THEN 'R1_NO_DOWN_CSP_H3' WHEN here >= 2 AND wide AND NOT elsewhere THEN 'R2_MULTI_CSP_ONE_H3' WHEN here >= 2 AND wide AND elsewhere THEN 'R3_MULTI_CSP_MULTI_H3'
  WHEN here < 2 AND n_cells >= 2 AND 10 * n_down >= 8 * n_cells AND near THEN 'R4_CSP_WIDE' WHEN here < 2 AND n_cells >= 2 AND 10 * n_down < 8 * n_cells AND near_up THEN 'R5_NEIGHBOR_CSP_UP'
  WHEN here >= 2 OR n_cells < 2 THEN 'R6_NO_CROSS_H3_COMPARISON' WHEN NOT near THEN 'R6_NO_NEIGHBOR_CSP' ELSE 'R6_AMBIGUOUS_PATTERN' END AS rule FROM fx),
an AS (SELECT outage, 'AE' || lpad(e::VARCHAR, 6, '0') AS event, csp, CASE WHEN rule NOT LIKE 'R0%' THEN cell END AS target_cell, dd AS down_csp, de AS eligible_csp, CASE WHEN rule NOT LIKE 'R0%' THEN failed ELSE 0 END AS failed, CASE WHEN rule NOT LIKE 'R0%' THEN eligible ELSE 0 END AS eligible, CASE WHEN rule NOT LIKE 'R0%' THEN compared ELSE 0 END AS compared, n_down AS affected_cells, n_cells AS eligible_cells, rule,
  CASE WHEN rule IN ('R0_CSP_DOWN_SHARE', 'R0_POLYGON_PEER_UP', 'R4_CSP_WIDE', 'R5_NEIGHBOR_CSP_UP') THEN 'CSP_SIDE' ELSE 'UNKNOWN' END AS cause,
  CASE WHEN rule IN ('R0_CSP_DOWN_SHARE', 'R3_MULTI_CSP_MULTI_H3', 'R4_CSP_WIDE') THEN 'REGIONAL' ELSE 'LOCAL' END AS extent,
  CASE rule WHEN 'R0_CSP_DOWN_SHARE' THEN CASE WHEN 10 * dd > 8 * de THEN 'HIGH' ELSE 'MEDIUM' END WHEN 'R0_POLYGON_PEER_UP' THEN 'MEDIUM' WHEN 'R4_CSP_WIDE' THEN CASE WHEN above THEN 'HIGH' ELSE 'MEDIUM' END WHEN 'R5_NEIGHBOR_CSP_UP' THEN CASE WHEN above THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS confidence FROM ru)"""
BATCH = f"WITH RECURSIVE {FLEET}, {OUTAGES}, {CHAIN}"


def batch(spark, sf_dir):
    """(fleet, outages, members)."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("user_id").alias("last"))  # one row
    cell = F.when(k % 13 == 4, None).when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("m"), (n % 3).cast("string"))).otherwise(F.concat(F.lit("h"), F.floor(n / 6).cast("string")))
    lat = F.when(k % 17 != 3, 20 + F.floor(n / 6) * F.lit(0.05) + (k % 10) * F.lit(0.01))
    lon = F.when(k % 17 != 3, 77 + (n % 6) * F.lit(0.02) + F.floor(k / 10) % 10 * F.lit(0.01))
    fleet = table(spark, sf_dir, "customer").join(F.broadcast(last), k <= F.col("last"))
    fleet = fleet.select(k.alias("device"), F.concat("c_mktsegment", (n % 3).cast("string")).alias("csp"), cell.alias("cell"), lat.alias("lat"), lon.alias("lon"), (k % 11 != 5).alias("active"))
    span = F.floor(F.sqrt(F.dayofmonth("ts") - 1)).cast("string")
    first = events.where("event_type = 'error'").groupBy(F.col("user_id").alias("device"), span.alias("bin")).agg(F.min("ts").alias("t"))
    members = first.join(fleet.select("device", "csp"), "device").select("device", "csp", F.concat("csp", F.lit(":"), "bin").alias("outage"), "t")
    outages = members.groupBy("outage", "csp").agg(F.date_trunc("second", F.min("t")).cast("timestamp_ntz").alias("trigger"))
    return fleet, outages, members.select("outage", "device")


@query("d14_rule_chain", f"{BATCH} SELECT * FROM an")
def d14(spark, sf_dir):
    return attribution.attributed(*batch(spark, sf_dir), window_s=21_600)


@query("d13_target_cell", f"{BATCH} SELECT outage, target_cell, failed, eligible FROM an WHERE target_cell IS NOT NULL")
def d13(spark, sf_dir):
    return attribution.attributed(*batch(spark, sf_dir), window_s=21_600).where("target_cell IS NOT NULL").select("outage", "target_cell", "failed", "eligible")


@query("k1_four_outputs", f"""{BATCH} SELECT 'cell_states' AS name, count(*) AS rows, sum(hash_free)::BIGINT AS total FROM (SELECT failed + eligible AS hash_free FROM st) UNION ALL SELECT 'events', count(DISTINCT e), count(*) FROM r
UNION ALL SELECT 'evidence', count(*), sum(down_csp + eligible_csp + failed + eligible + compared + affected_cells + eligible_cells)::BIGINT FROM an UNION ALL SELECT 'attributions', count(*), count(*) FILTER (cause = 'CSP_SIDE') FROM an""")
def k1(spark, sf_dir):
    """The four tables of a run, published as one version and read back; a row and a sum for each."""
    fleet, outages, members = batch(spark, sf_dir)
    found = tables.cut(attribution.attributed(fleet, outages, members, window_s=21_600))
    events = attribution.event_groups(outages, 21_600)
    states = attribution.cell_states(fleet, members.join(events.select("outage", "event"), "outage").join(fleet, "device"))
    four = {
        "cell_states": states, "events": events.groupBy("event").agg(F.min("trigger").alias("start"), F.max("trigger").alias("stop"), F.count("*").alias("outages")),
        "evidence": found.drop("cause", "extent", "confidence"), "attributions": found.select("outage", "cause", "extent", "confidence"),
    }
    root = tables.shared_path(spark)
    feeds.publish(four, root, 1)
    total = {"cell_states": "failed + eligible", "events": "outages", "evidence": "down_csp + eligible_csp + failed + eligible + compared + affected_cells + eligible_cells", "attributions": "CAST(cause = 'CSP_SIDE' AS BIGINT)"}
    out = None
    for name, df in feeds.newest_of(spark, root).items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(F.expr(total[name])).cast("long").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("d12_event_groups", f"WITH RECURSIVE {FLEET}, {OUTAGES} SELECT outage, csp, trig AS trigger, 'AE' || lpad(e::VARCHAR, 6, '0') AS event FROM r")
def d12(spark, sf_dir):
    return attribution.event_groups(batch(spark, sf_dir)[1], 21_600)


#: Live: states now (a device of the fleet without any ping is UNKNOWN); a group is a cell of the fleet, whose target is a provider.
LIVE = f"""{FLEET}, lv AS (SELECT fl.*, CASE WHEN t IS NULL OR t > TIMESTAMP '2024-01-30 12:00:00' THEN 'UNKNOWN' WHEN floor(epoch(TIMESTAMP '2024-01-30 12:00:00')) - floor(epoch(t)) >= 86400 THEN 'DOWN' ELSE 'UP' END AS state
  FROM fl LEFT JOIN (SELECT user_id, max(ts) AS t FROM events JOIN fl ON fl.device = user_id WHERE event_type <> 'error' AND user_id % 19 <> 7
    AND NOT (ts > TIMESTAMP '2024-01-25' AND coalesce(cell = 'h1' OR cell = 'h2' AND csp LIKE 'BUILDING%' OR cell = 'm1' OR cell = 'm2' AND user_id % 5 <> 0, false)) GROUP BY 1) ON user_id = device)"""
GATE = "ga AS (SELECT csp, count(*) FILTER (state = 'DOWN') AS down, count(*) FILTER (state = 'UP') AS up, count(*) FILTER (state = 'UNKNOWN') AS unknown, count(*) AS eligible FROM lv GROUP BY csp)"
GROUPS = "lg AS (SELECT device, csp, state, csp || '/' || (device % 4) AS outage, coalesce(cell, 'none') AS place, device % 2 AS part FROM lv)"
TABLE = """pc AS (SELECT place, part, csp, count(*) FILTER (state = 'DOWN') AS down, count(*) FILTER (state = 'UP') AS up, count(*) FILTER (state = 'UNKNOWN') AS unknown, count(*) AS eligible FROM lg GROUP BY 1, 2, 3),
pv AS (SELECT *, round(down::DOUBLE / eligible, 4) AS down_share, round(up::DOUBLE / eligible, 4) AS up_share, eligible >= 2 AS qualified FROM pc)"""
TARGETS = "tt AS (SELECT DISTINCT place, part, csp AS target FROM lg)"
LOCAL = """lc AS (SELECT tt.*,
    (SELECT max(down_share) FROM pv WHERE qualified AND pv.place = tt.place AND pv.part = tt.part AND csp = target) AS t,
    (SELECT count(*) FROM pv WHERE qualified AND pv.place = tt.place AND pv.part = tt.part AND csp <> target) AS peers,
    NOT EXISTS (SELECT 1 FROM pv WHERE qualified AND pv.place = tt.place AND pv.part = tt.part AND csp <> target AND down_share > 0.2) AS peers_up,
    (SELECT min(down_share) FROM pv WHERE qualified AND pv.place = tt.place AND pv.part = tt.part) AS low,
    (SELECT count(*) FROM pv WHERE qualified AND pv.place = tt.place AND pv.part = tt.part) AS n FROM tt),
ld AS (SELECT place, part, target, CASE WHEN t >= 0.8 AND peers > 0 AND peers_up THEN 'RULE_2A_LOCAL_CSP_PEERS' WHEN t >= 0.9 AND peers = 0 THEN 'RULE_2B_LOCAL_CSP_MONOPOLY' WHEN n >= 2 AND low >= 0.7 THEN 'RULE_3A_POWER_MULTI_CSP' WHEN t >= 0.7 AND peers = 0 THEN 'RULE_3B_POWER_MONOPOLY' ELSE 'RULE_4_FIBRE_CHECK' END AS rule, low FROM lc),
le AS (SELECT place, part, target, rule, CASE WHEN rule LIKE 'RULE_2%' THEN 'CSP_SPECIFIC_LOCAL' WHEN rule LIKE 'RULE_3%' THEN 'PREMISE_POWER' ELSE 'UNKNOWN' END AS cause,
  CASE rule WHEN 'RULE_2A_LOCAL_CSP_PEERS' THEN 0.8 WHEN 'RULE_2B_LOCAL_CSP_MONOPOLY' THEN 0.6 WHEN 'RULE_3B_POWER_MONOPOLY' THEN 0.6 WHEN 'RULE_3A_POWER_MULTI_CSP' THEN round(least(0.9, low), 2) ELSE 0 END::DOUBLE AS confidence FROM ld)"""


def live(spark, sf_dir):
    """Devices of the fleet with their state, the outage that they belong to and the place and part that they lie in."""
    fleet, now = batch(spark, sf_dir)[0], F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    gone = F.expr("ts > timestamp_ntz'2024-01-25' AND coalesce(cell = 'h1' OR cell = 'h2' AND csp LIKE 'BUILDING%' OR cell = 'm1' OR cell = 'm2' AND device % 5 <> 0, false)")
    last = table(spark, sf_dir, "events").where("event_type <> 'error' AND user_id % 19 <> 7").withColumnRenamed("user_id", "device").join(fleet.select("device", "csp", "cell"), "device")
    last = last.where(~gone).groupBy("device").agg(F.max("ts").alias("t"))
    age = F.when(F.col("t") <= now, seconds(now) - seconds("t"))
    x = fleet.join(last, "device", "left").withColumn("state", rules.device_state(age, 86_400))
    outage = F.concat("csp", F.lit("/"), (F.col("device") % 4).cast("string"))
    return x.withColumns({"outage": outage, "place": F.coalesce("cell", F.lit("none")), "part": F.col("device") % 2})


@query("d5_provider_gate", f"WITH {LIVE}, {GATE} SELECT *, round(down::DOUBLE / eligible, 4) AS down_share, round(down::DOUBLE / eligible, 4) >= 0.7 AS matched, CASE WHEN down::DOUBLE / eligible >= 0.7 THEN 0.8::DOUBLE END AS confidence FROM ga")
def d5(spark, sf_dir):
    return attribution.provider_gate(live(spark, sf_dir))


@query("a16_provider_table", f"WITH {LIVE}, {GROUPS}, {TABLE} SELECT *, CASE WHEN qualified THEN 'ELIGIBLE' ELSE 'BELOW_MINIMUM' END AS reason FROM pv")
def a16(spark, sf_dir):
    return attribution.providers(live(spark, sf_dir), ["place", "part"], least=2)


def decided(spark, sf_dir):
    x = live(spark, sf_dir)
    keys = ["place", "part"]
    targets = x.select(*keys, F.col("csp").alias("target")).distinct()
    return attribution.local_decisions(attribution.providers(x, keys, least=2), targets, keys)


@query("d6_local_rules", f"WITH {LIVE}, {GROUPS}, {TABLE}, {TARGETS}, {LOCAL} SELECT * FROM le")
def d6(spark, sf_dir):
    return decided(spark, sf_dir)


@query("d10_rollup", f"""WITH {LIVE}, {GATE}, {GROUPS}, {TABLE}, {TARGETS}, {LOCAL},
ms AS (SELECT outage, csp, place, part, count(*) FILTER (state = 'DOWN') AS down, count(*) AS n FROM lg GROUP BY 1, 2, 3, 4),
gr AS (SELECT outage, csp, ms.place || ms.part AS idx, n % 3 <> 0 AS supported, CASE WHEN n % 3 = 0 AND ms.part = 1 THEN 'FIBRE_CUT' WHEN n % 3 <> 0 THEN cause ELSE 'UNKNOWN' END AS cause, CASE WHEN n % 3 = 0 AND ms.part = 1 THEN 0.7::DOUBLE WHEN n % 3 <> 0 THEN confidence ELSE 0 END AS confidence, CASE WHEN n % 3 = 0 AND ms.part = 1 THEN 'RULE_4A_HOUSE_GALI' WHEN n % 3 <> 0 THEN rule ELSE 'SPATIAL_REVIEW' END AS rule
  FROM ms JOIN le ON le.place = ms.place AND le.part = ms.part AND target = csp WHERE down > 0),
cg AS (SELECT * FROM gr WHERE supported OR cause = 'FIBRE_CUT'),
os AS (SELECT outage, any_value(csp) AS csp, sum(n)::BIGINT AS known, sum(down)::BIGINT AS located FROM ms GROUP BY 1),
fo AS (SELECT os.*, round(ga.down::DOUBLE / eligible, 4) >= 0.7 AS gate, CASE WHEN ga.down::DOUBLE / eligible >= 0.7 THEN 0.8::DOUBLE END AS gc,
  (SELECT count(DISTINCT cause) FROM cg WHERE cg.outage = os.outage) AS causes, (SELECT min(cause) FROM cg WHERE cg.outage = os.outage) AS one, (SELECT min(confidence) FROM cg WHERE cg.outage = os.outage) AS least_c,
  (SELECT rule FROM cg WHERE cg.outage = os.outage ORDER BY idx LIMIT 1) AS first_rule, (SELECT count(*) FROM gr WHERE gr.outage = os.outage AND supported) AS sup, (SELECT rule FROM gr WHERE gr.outage = os.outage AND supported ORDER BY idx LIMIT 1) AS sup_rule FROM os JOIN ga ON ga.csp = os.csp)
SELECT outage, CASE WHEN gate THEN 'ISP_OLT_CSP_SIDE' WHEN causes = 1 AND one <> 'UNKNOWN' THEN one ELSE 'UNKNOWN' END AS cause, CASE WHEN gate THEN gc WHEN causes = 1 AND one <> 'UNKNOWN' THEN least_c ELSE 0 END AS confidence,
CASE WHEN gate THEN 'CSP_DOWN_SHARE' WHEN causes = 1 AND one <> 'UNKNOWN' THEN first_rule WHEN located = 0 THEN 'NO_CURRENT_DOWN_MEMBERS' WHEN sup = 0 THEN 'SUB_OUTAGE_REVIEW_ONLY' WHEN causes > 1 THEN 'LOCAL_GROUPS_DISAGREE' ELSE coalesce(sup_rule, 'LOCAL_PATTERN_AMBIGUOUS') END AS rule FROM fo""")
def d10(spark, sf_dir):
    x = live(spark, sf_dir)
    parts = x.groupBy("outage", "csp", "place", "part").agg(F.count_if(F.expr("state = 'DOWN'")).alias("down"), F.count("*").alias("n"))
    gate = attribution.provider_gate(x).select("csp", "matched", F.col("confidence").alias("gate_confidence"))
    outages = parts.groupBy("outage", "csp").agg(F.sum("n").alias("known"), F.sum("down").alias("located_down")).join(gate, "csp").drop("csp")
    fibre, e = F.expr("NOT supported AND part = 1"), F.expr
    groups = parts.where("down > 0").join(decided(spark, sf_dir).withColumnRenamed("target", "csp"), ["place", "part", "csp"]).withColumn("supported", e("n % 3 <> 0"))
    pick = lambda cut, c, review: F.when(fibre, cut).when(F.col("supported"), F.col(c)).otherwise(review).alias(c)
    groups = groups.select("outage", F.concat("place", F.col("part").cast("string")).alias("index"), "supported", pick("FIBRE_CUT", "cause", "UNKNOWN"), pick(0.7, "confidence", 0.0), pick("RULE_4A_HOUSE_GALI", "rule", "SPATIAL_REVIEW"))
    return attribution.rolled_up(outages, groups)
