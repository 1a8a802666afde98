"""Queries of sources with contracts, of sinks that are read back, and of small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hours import later
from ..sources import feeds, tables
from ..sources.tables import shared_path, table
from .registry import query


@query("s2_s4_chunked_scan", "SELECT user_id, count(*) AS n, min(ts) AS first_at FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-26' AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY 1")
def s2(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    parts = feeds.chunks(table(spark, sf_dir, "events"), ids, "user_id", "2024-01-03 00:00:00", "2024-01-26 00:00:00")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"))


INVENTORY_SQL = """v AS (SELECT c_custkey::VARCHAR AS device_id, nullif(trim(CASE WHEN c_custkey % 101 = 7 THEN ' ' ELSE c_mktsegment END), '') AS csp, CASE c_custkey % 5 WHEN 0 THEN 'false' WHEN 1 THEN NULL WHEN 2 THEN '1' ELSE ' TRUE ' END AS is_active FROM customer
UNION ALL SELECT c_custkey::VARCHAR, c_mktsegment, 'true' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'OTHER', 'true' FROM customer WHERE c_custkey % 50 = 11 UNION ALL SELECT c_custkey::VARCHAR, c_mktsegment, 'maybe' FROM customer WHERE c_custkey % 97 = 5),
a AS (SELECT DISTINCT device_id, csp FROM v WHERE coalesce(lower(trim(is_active)), 'true') IN ('true', '1'))"""


def inventory(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    row = lambda df, csp, flag: df.select(k.cast("string").alias("device_id"), csp.alias("csp"), flag.alias("is_active"))
    flag = F.when(k % 5 == 0, "false").when(k % 5 == 1, None).when(k % 5 == 2, "1").otherwise(" TRUE ")
    first = row(c, F.when(k % 101 == 7, " ").otherwise(F.col("c_mktsegment")), flag)
    again = row(c.where(k % 3 == 0), F.col("c_mktsegment"), F.lit("true"))
    other = row(c.where(k % 50 == 11), F.lit("OTHER"), F.lit("true"))
    return first.unionByName(again).unionByName(other).unionByName(row(c.where(k % 97 == 5), F.col("c_mktsegment"), F.lit("maybe")))


@query("s6_registry", f"WITH {INVENTORY_SQL} SELECT * FROM a")
def s6(spark, sf_dir):
    return feeds.registry(inventory(spark, sf_dir), "device_id", ["device_id", "csp"], "is_active")[0]


@query("s6_registry_conflicts", f"WITH {INVENTORY_SQL} SELECT device_id, 'invalid_flag' AS reason FROM v WHERE lower(trim(is_active)) NOT IN ('true', '1', 'false', '0') UNION ALL SELECT device_id, 'missing_value' FROM a WHERE device_id IS NULL OR csp IS NULL UNION ALL SELECT device_id, 'conflict' FROM a GROUP BY 1 HAVING count(*) > 1")
def s6_conflicts(spark, sf_dir):
    return feeds.registry(inventory(spark, sf_dir), "device_id", ["device_id", "csp"], "is_active")[1]


FEED_SQL = """f AS (SELECT o_custkey AS feed, CASE o_custkey % 11 WHEN 1 THEN '[1]' WHEN 2 THEN '{"as_of":1700000000,"count":1,"outages":{}}' WHEN 3 THEN '{"as_of":"1700000000","count":0,"outages":[]}' ELSE
'{"as_of":' || (1700000000 + CASE WHEN o_custkey % 11 = 4 THEN 700 ELSE o_custkey % 600 END) || ',"count":' || (count(*) + (o_custkey % 11 = 5)::INT + (o_custkey % 11 = 6)::INT) || ',"outages":[' || string_agg('{"outage_id":' || o_orderkey || ',"devices":["d"]}', ',' ORDER BY o_orderkey) || CASE WHEN o_custkey % 11 = 6 THEN ',{"outage_id":' || min(o_orderkey) || ',"devices":[]}' ELSE '' END || ']}' END AS payload FROM orders GROUP BY 1)"""


@query("s9_feed_contract", f"""WITH {FEED_SQL}, j AS (SELECT feed, payload, CASE WHEN json_type(payload) <> 'OBJECT' THEN 'not_an_object' WHEN json_type(payload, '$.outages') <> 'ARRAY' THEN 'no_list' WHEN json_type(payload, '$.as_of') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'no_epoch' WHEN abs((payload ->> '$.as_of')::BIGINT - 1700000000) > 600 THEN 'stale' WHEN (payload ->> '$.count')::BIGINT <> json_array_length(payload, '$.outages') THEN 'count'
WHEN len(list_distinct(json_extract_string(payload, '$.outages[*].outage_id'))) < json_array_length(payload, '$.outages') THEN 'duplicate' ELSE 'OK' END AS reason FROM f) SELECT feed, reason FROM j""")
def s9(spark, sf_dir):
    k, o = F.col("o_custkey") % 11, F.col("o_orderkey")
    entry = F.concat(F.lit('{"outage_id":'), o.cast("string"), F.lit(',"devices":["d"]}'))
    x = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(o.alias("o"), entry.alias("e")))).alias("es"), F.count("*").alias("n"), F.min(o).alias("lo"))
    listed = F.array_join(F.transform("es", lambda e: e["e"]), ",")
    more = F.when(k == 6, F.concat(F.lit(',{"outage_id":'), F.col("lo").cast("string"), F.lit(',"devices":[]}'))).otherwise("")
    at = (1700000000 + F.when(k == 4, 700).otherwise(F.col("o_custkey") % 600)).cast("string")
    count = (F.col("n") + (k == 5).cast("int") + (k == 6).cast("int")).cast("string")
    whole = F.concat(F.lit('{"as_of":'), at, F.lit(',"count":'), count, F.lit(',"outages":['), listed, more, F.lit("]}"))
    payload = F.when(k == 1, "[1]").when(k == 2, '{"as_of":1700000000,"count":1,"outages":{}}').when(k == 3, '{"as_of":"1700000000","count":0,"outages":[]}').otherwise(whole)
    return x.select(F.col("o_custkey").alias("feed"), payload.alias("payload")).select("feed", feeds.feed_reason(F.col("payload"), 1700000000).alias("reason"))


@query("s10_status_lookup", "SELECT DISTINCT o_custkey AS device, t AS last_at, n FROM orders LEFT JOIN (SELECT user_id, max(ts) AS t, count(*) AS n FROM events GROUP BY 1) ON user_id = o_custkey")
def s10(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("device")).agg(F.max("ts").alias("last_at"), F.count("*").alias("n"))
    return feeds.status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device")), last, "device")


CSV = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s7_s8_s11_k1_csv", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IS NOT NULL AND regexp_matches(c_name, '[02468]$')")
def s8(spark, sf_dir):
    """A table is written as gzip CSV into a new folder and read back by its contract, two columns of it and files of today only."""
    path = shared_path(spark)
    table(spark, sf_dir, "customer").write.mode("errorifexists").option("header", True).option("compression", "gzip").csv(path)
    now = spark.sql("SELECT date_format(now() + INTERVAL 5 MINUTES, 'yyyy-MM-dd HH:mm:ss')").first()[0]
    x = tables.csv_table(spark, path, CSV, gate_hours=24, as_of=now)
    return x.where(F.col("c_nationkey").isNotNull() & F.col("c_name").rlike("[02468]$")).select("c_custkey", "c_mktsegment")


@query("s5_contract", "SELECT 'name' AS rule, 0::BIGINT AS n UNION ALL SELECT 'balance', count(*) FILTER (c_acctbal < -900) FROM customer UNION ALL SELECT 'one_c_nationkey', count(*) FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1)")
def s5(spark, sf_dir):
    path = shared_path(spark)
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    x = tables.csv_table(spark, path, CSV)
    return tables.violations(x, "c_mktsegment", {"name": F.col("c_name").isNotNull(), "balance": F.col("c_acctbal") >= -900}, ("c_nationkey",))


@query("s13_scraped_names", "SELECT found, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]{2,})', 1)) AS found FROM benchmark) GROUP BY 1")
def s13(spark, sf_dir):
    path = shared_path(spark)
    table(spark, sf_dir, "benchmark").select(F.col("text").alias("value")).write.text(path)
    return feeds.texts(spark, path, "([A-Z][a-z]{2,})").groupBy("found").agg(F.count("*").alias("n"))


@query("s16_rings", "SELECT c_nationkey, c_custkey, (20 + c_nationkey * 0.1::DOUBLE + 0.001::DOUBLE * sin(t))::DECIMAL(18,9) AS lat, (77 + 0.001::DOUBLE * cos(t))::DECIMAL(18,9) AS lon FROM (SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 2 * pi() / count(*) OVER (PARTITION BY c_nationkey) AS t FROM customer)")
def s16(spark, sf_dir):
    x = feeds.rings(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")
    return x.select("c_nationkey", "c_custkey", *(F.col(c).cast("decimal(18,9)").alias(c) for c in ("lat", "lon")))


@query("k3_geojson", "SELECT count(*) AS n, min(c_custkey) AS first_id, sum(c_nationkey)::BIGINT AS total FROM customer")
def k3(spark, sf_dir):
    """Features are written as lines, in order, and read back."""
    ring = F.lit('{"type":"Polygon","coordinates":[[[77.0,20.0],[77.1,20.0],[77.1,20.1],[77.0,20.0]]]}')
    path = shared_path(spark)
    lines = tables.geojson(table(spark, sf_dir, "customer").withColumn("g", ring), "g", ["c_custkey", "c_nationkey"], ["c_custkey"])
    lines.write.text(path)
    p = F.from_json(F.get_json_object("value", "$.properties"), "c_custkey long, c_nationkey long")
    good = spark.read.text(path).where(F.get_json_object("value", "$.geometry.coordinates[0][2][1]") == "20.1").select(p.alias("p"))
    return good.agg(F.count("*").alias("n"), F.min("p.c_custkey").alias("first_id"), F.sum("p.c_nationkey").alias("total"))


@query("k4_f48_device_payload", "WITH b AS (SELECT user_id, sum(DISTINCT 1::HUGEINT << day(ts)::INT) AS bits FROM events GROUP BY 1) SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx, to_base64(unhex(lpad(hex(bits & 255), 2, '0') || lpad(hex((bits >> 8) & 255), 2, '0') || lpad(hex((bits >> 16) & 255), 2, '0') || lpad(hex((bits >> 24) & 255), 2, '0'))) AS bitmap FROM b")
def k4(spark, sf_dir):
    """Days of a month as a bitmap, in Base64; devices are told by their place in the order of ids, which comes from ranges."""
    from ..operators.scores import running

    bits = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.day("ts"))).alias("bits"))
    x = running(bits, [F.col("user_id")], {"k": F.lit(1)})
    return x.select("user_id", (F.col("k") - 1).cast("long").alias("idx"), feeds.bitmap64(F.array("bits"), 4).alias("bitmap"))


@query("k5_k8_bundle")
def k5(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return feeds.bundle({"nation": n, "region": table(spark, sf_dir, "region")}, shared_path(spark), {})


@query("x10_k1_newest_version", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def newest(spark, sf_dir):
    root, n = shared_path(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    feeds.snapshot(n, root, 1)
    feeds.snapshot(n.where("n_nationkey % 2 = 1"), root, 2)
    return feeds.newest(spark, root)


@query("p3_p5_p10_filters", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus = 'F', o_orderkey % 4 = 0), false) AND o_orderdate + INTERVAL 12 HOUR > TIMESTAMP '1995-06-01 12:00:00' AND NOT regexp_matches(o_orderkey::VARCHAR, '^[0-9]{2}[5-9]')")
def p3(spark, sf_dir):
    """Rows not deleted (a null flag means not), later than a border, which is strict, and not of a made-up family."""
    gone = F.nullif(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 4 == 0)
    late = later("o_orderdate", 12) > F.lit("1995-06-01 12:00:00").cast("timestamp_ntz")
    family = F.col("o_orderkey").cast("string").rlike("^[0-9]{2}[5-9]")
    return table(spark, sf_dir, "orders").where(~F.coalesce(gone, F.lit(False)) & late & ~family).select("o_orderkey")


@query("f14_f28_parse", "SELECT o_orderkey, nullif(nullif(regexp_replace(trim(s), '\\.0+$', ''), ''), 'nan') AS mobile, coalesce(try_strptime(d, '%Y-%m-%d %H:%M:%S'), try_strptime(d, '%d/%m/%Y %H:%M'), try_strptime(d, '%Y%m%d')) AS at FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'nan' WHEN 2 THEN o_custkey || '.0' ELSE o_custkey::VARCHAR END AS s, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN 'soon' END AS d FROM orders)")
def f14(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    s = F.when(k % 4 == 0, " ").when(k % 4 == 1, "nan").when(k % 4 == 2, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).otherwise(F.col("o_custkey").cast("string"))
    forms = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyyMMdd")
    w = F.when(k % 5 == 0, F.date_format(d, forms[0])).when(k % 5 == 1, F.date_format(d, forms[1])).when(k % 5 == 2, F.date_format(d, forms[2])).when(k % 5 == 3, "soon")
    x = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"), w.alias("d"))
    at = F.coalesce(*(F.try_to_timestamp("d", F.lit(f)) for f in forms)).cast("timestamp_ntz")
    bare = F.nullif(F.nullif(F.regexp_replace(F.trim("s"), r"\.0+$", ""), F.lit("")), F.lit("nan"))
    return x.select("o_orderkey", bare.alias("mobile"), at.alias("at"))


@query("f16_f46_f49_json", """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '{"line1":"' || c_name || '"}' WHEN c_custkey % 9 = 1 THEN 'no json' ELSE '{"line1":"' || c_name || '","area":"' || c_mktsegment || '","scores":{"road":{"a":0.5,"b":' || (c_custkey % 10) || '}}}' END AS j FROM customer),
v AS (SELECT c_custkey, CASE WHEN json_valid(j) THEN j END AS j FROM a)
SELECT c_custkey, concat_ws(', ', j ->> '$.line1', j ->> '$.area') AS address, greatest((j ->> '$.scores.road.a')::DOUBLE, (j ->> '$.scores.road.b')::DOUBLE) AS best FROM v""")
def f46(spark, sf_dir):
    k = F.col("c_custkey")
    start = F.concat(F.lit('{"line1":"'), "c_name", F.lit('"'))
    whole = F.concat(start, F.lit(',"area":"'), F.col("c_mktsegment"), F.lit('","scores":{"road":{"a":0.5,"b":'), (k % 10).cast("string"), F.lit("}}}"))
    j = F.when(k % 9 == 0, F.concat(start, F.lit("}"))).when(k % 9 == 1, "no json").otherwise(whole)
    x = table(spark, sf_dir, "customer").select("c_custkey", j.alias("j"))
    scores = F.from_json(F.get_json_object("j", "$.scores"), "map<string, map<string, double>>")
    address = F.concat_ws(", ", F.get_json_object("j", "$.line1"), F.get_json_object("j", "$.area"))
    return x.select("c_custkey", address.alias("address"), F.array_max(F.map_values(F.element_at(scores, "road"))).alias("best"))


@query("f47_a15_evidence", """WITH e AS (SELECT DISTINCT c_mktsegment AS provider, c_nationkey AS cell, c_custkey AS device FROM customer WHERE c_custkey % 7 < 5), g AS (SELECT provider, cell, count(DISTINCT device) AS devices FROM e GROUP BY 1, 2)
SELECT provider, '[' || string_agg('{"cell":' || cell || ',"devices":' || devices || '}', ',' ORDER BY cell) || ']' AS evidence FROM g GROUP BY 1""")
def f47(spark, sf_dir):
    g = table(spark, sf_dir, "customer").where("c_custkey % 7 < 5").groupBy(F.col("c_mktsegment").alias("provider"), F.col("c_nationkey").alias("cell")).agg(F.count_distinct("c_custkey").alias("devices"))
    rows = F.array_sort(F.collect_list(F.struct("cell", "devices")))
    return g.groupBy("provider").agg(F.to_json(rows).alias("evidence"))


@query("a14_o5_earliest_failure", "SELECT user_id, coalesce(max(CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN ts END), min(CASE WHEN event_type = 'error' THEN ts END)) AS earliest, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT e2.event_type AS x FROM events e2 WHERE e2.user_id = e.user_id)) AS kinds FROM events e GROUP BY 1")
def a14(spark, sf_dir):
    """The time of a trigger, where one is given, else that of the first failure; kinds in a fixed order."""
    trigger = F.max(F.when((F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0), F.col("ts")))
    first = F.min(F.when(F.col("event_type") == "error", F.col("ts")))
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(trigger, first).alias("earliest"), kinds.alias("kinds"))


@query("j11_disk_neighbours", "WITH g AS (SELECT c_nationkey % 5 AS x, c_nationkey // 5 AS y, count(*) AS n FROM customer GROUP BY 1, 2), d AS (SELECT g.x, g.y, g.n, i, j FROM g, (SELECT a.i, b.i AS j FROM range(-2, 3) a(i), range(-2, 3) b(i)) WHERE greatest(abs(i), abs(j), abs(i + j)) BETWEEN 1 AND 2) SELECT d.x, d.y, d.n, coalesce(sum(o.n), 0)::BIGINT AS around FROM d LEFT JOIN g o ON o.x = d.x + i AND o.y = d.y + j GROUP BY 1, 2, 3")
def j11(spark, sf_dir):
    """Sums over the disk of two rings around each hexagon (axial coordinates), its own apart; every cell is sent to its disk."""
    g = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("x"), F.floor(F.col("c_nationkey") / 5).alias("y")).agg(F.count("*").alias("n"))
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if 1 <= max(abs(i), abs(j), abs(i + j)) <= 2]
    disk = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    sent = g.withColumn("s", disk).groupBy((F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y")).agg(F.sum("n").alias("around"))
    return g.join(sent, ["x", "y"], "left").withColumn("around", F.coalesce("around", F.lit(0).cast("long")))
