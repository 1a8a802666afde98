"""Relational queries: joins, aggregates, sets, order, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import identity, leaves
from ..sources import tables
from ..sources.tables import table
from .registry import query


@query("a8_quarantine", "SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT ROW(l_partkey, l_suppkey, l_quantity)) FILTER (l_quantity <= 45) AS variants, count(*) FILTER (NOT coalesce(l_quantity <= 45, false)) AS invalid, count(DISTINCT ROW(l_partkey, l_suppkey, l_quantity)) FILTER (l_quantity <= 45) = 1 AND count(*) FILTER (NOT coalesce(l_quantity <= 45, false)) = 0 AS kept FROM lineitem GROUP BY 1, 2")
def a8(spark, sf_dir):
    return identity.quarantined(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"], F.col("l_quantity") <= 45)


@query("a8_lenient_first_row", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def a8_lenient(spark, sf_dir):
    return identity.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c).asc_nulls_last() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("a9_consistency", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus, CASE count(DISTINCT o_orderstatus) WHEN 0 THEN 'MISSING' WHEN 1 THEN 'OK' ELSE 'CONFLICT' END AS status FROM orders GROUP BY 1")
def a9(spark, sf_dir):
    return identity.consistent(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query(
    "j16_one_to_one",
    "WITH p AS (SELECT DISTINCT p_partkey % 1500 AS a, p_partkey * p_size % 3001 AS b FROM part) SELECT a, b FROM p WHERE a IN (SELECT a FROM p GROUP BY a HAVING count(*) = 1) AND b IN (SELECT b FROM p GROUP BY b HAVING count(*) = 1)",
)
def j16(spark, sf_dir):
    k = F.col("p_partkey")
    return identity.one_to_one(table(spark, sf_dir, "part").select((k % 1500).alias("a"), (k * F.col("p_size") % 3001).alias("b")), "a", "b")


@query(
    "w3_bridge",
    "WITH p AS (SELECT s_suppkey, (s_nationkey * 8 + s_suppkey % 8)::BIGINT AS account FROM supplier) SELECT * FROM p WHERE account IN (SELECT account FROM p GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1)",
)
def w3(spark, sf_dir):
    account = (F.col("s_nationkey") * 8 + F.col("s_suppkey") % 8).cast("long").alias("account")
    return identity.one_to_one(table(spark, sf_dir, "supplier").select("s_suppkey", account), "s_suppkey", "account")


@query("j15_serial_bridge", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON regexp_replace(upper(trim(c_name)), '[^0-9]', '', 'g') = regexp_replace(upper(trim(s_name)), '[^0-9]', '', 'g')")
def j15(spark, sf_dir):
    key = lambda c: F.regexp_replace(identity.serial(c), "[^0-9]", "")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, key("c_name") == key("s_name")).select("c_custkey", "s_suppkey")


@query("j1_left_chain", "SELECT o_orderkey, coalesce(n_name, 'NONE') AS nation, coalesce(r_name, 'NONE') AS region FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def j1(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    x = o.join(c.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return x.select("o_orderkey", F.coalesce("n_name", F.lit("NONE")).alias("nation"), F.coalesce("r_name", F.lit("NONE")).alias("region"))


@query("j3_bounds_cross", "SELECT o_orderkey, date_diff('day', lo, o_orderdate) AS day FROM orders, (SELECT min(o_orderdate) AS lo FROM orders)")
def j3(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.min("o_orderdate").alias("lo")))).select("o_orderkey", F.datediff("o_orderdate", "lo").cast("long").alias("day"))


@query("j13_scalar_counts", " UNION ALL ".join(f"SELECT '{t}' AS metric, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")) + " UNION ALL SELECT 'customers_with_orders', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j13(spark, sf_dir):
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    every = [one(table(spark, sf_dir, t), t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")]
    every.append(one(table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"), "customers_with_orders"))
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out


@query("j17_service_filter", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' + to_days((c_custkey % 700)::INT) AND o_orderdate < TIMESTAMP '1997-01-01' + to_days((c_custkey % 700)::INT)")
def j17(spark, sf_dir):
    since = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 700).cast("int"))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).where((F.col("o_orderdate") >= since(1995)) & (F.col("o_orderdate") < since(1997))).select("o_orderkey")


@query("j18_priority_merge", "SELECT n_nationkey::BIGINT AS n_nationkey, coalesce(s.k, c.k) AS k, CASE WHEN s.k IS NOT NULL THEN 'supplier' WHEN c.k IS NOT NULL THEN 'customer' ELSE 'missing' END AS source FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def j18(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("s"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("c"))
    x = table(spark, sf_dir, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return x.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.coalesce("s", "c").alias("k"), F.when(F.col("s").isNotNull(), "supplier").when(F.col("c").isNotNull(), "customer").otherwise("missing").alias("source"))


@query("j22_latest_partition", "SELECT o_orderkey, o_orderdate = (SELECT max(o_orderdate) FROM orders) AS latest FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 14 DAY")
def j22(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    return o.crossJoin(F.broadcast(last)).where("o_orderdate >= last - INTERVAL 14 DAYS").select("o_orderkey", (F.col("o_orderdate") == F.col("last")).alias("latest"))


@query("j_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("p12_tuple_semi", "SELECT c_custkey FROM customer WHERE (c_nationkey, c_custkey % 3) IN ((0, 0), (1, 1), (2, 2), (3, 1))")
def p12(spark, sf_dir):
    keys = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 1)], "c_nationkey int, part long")
    c = table(spark, sf_dir, "customer").withColumn("part", F.col("c_custkey") % 3)
    return c.join(F.broadcast(keys), ["c_nationkey", "part"], "left_semi").select("c_custkey")


@query("a1_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_orderkey END) AS big_orders, count(*) FILTER (l_discount > 0.05) AS discounted, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1, 2")
def a1(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_orderkey"))).alias("big_orders"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.sum("l_quantity").cast("long").alias("quantity"),
    )


@query("a3_having_ratio", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS returned FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def a3(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r")).where("n >= 5")
    return x.select("l_suppkey", "n", F.try_divide("r", "n").alias("returned"))


@query("a6_percentiles", "SELECT p_brand, " + ", ".join(f"quantile_cont(p_retailprice, {q})::DECIMAL(18,4) AS p{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM part GROUP BY 1")
def a6(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(*(F.percentile("p_retailprice", q).cast("decimal(18,4)").alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)))


BUCKET = "CASE WHEN spend IS NULL THEN 'missing' WHEN spend < 500000 THEN 'low' WHEN spend < 1500000 THEN 'middle' ELSE 'high' END"


@query("a17_bucket_summary", f"WITH s AS (SELECT c_custkey, c_mktsegment, spend FROM customer LEFT JOIN (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT // 100 AS spend FROM orders GROUP BY 1) ON o_custkey = c_custkey) SELECT c_mktsegment, {BUCKET} AS bucket, count(*) AS n, median(spend)::DOUBLE AS p50, min(spend) AS lo, max(spend) AS hi FROM s GROUP BY 1, 2")
def a17(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    s = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").withColumn("spend", F.expr("cents div 100"))
    return s.groupBy("c_mktsegment", F.expr(BUCKET).alias("bucket")).agg(F.count("*").alias("n"), F.median("spend").alias("p50"), F.min("spend").alias("lo"), F.max("spend").alias("hi"))


@query("a20_transitions", "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> p) AS changes, least(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus <> 'F')) AS minority FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) GROUP BY 1")
def a20(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    f = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").withColumn("p", F.lag("o_orderstatus").over(w)).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != F.col("p")).alias("changes"), F.least(F.count_if(f), F.count_if(~f)).alias("minority"))


@query("a24_suppression", "SELECT CASE WHEN n < 5 THEN 'OTHER' ELSE k::VARCHAR END AS cell, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY 1) GROUP BY 1")
def a24(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 8000").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return c.groupBy(F.when(F.col("n") < 5, "OTHER").otherwise(F.col("c_nationkey").cast("string")).alias("cell")).agg(F.sum("n").alias("n"))


@query("a26_sorted_members", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS members FROM orders GROUP BY 1")
def a26(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("members"))


@query("a11_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a11(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("p9_hash_sample", "SELECT c_custkey FROM customer WHERE ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 20 = 0")
def p9(spark, sf_dir):
    return identity.hash_sample(table(spark, sf_dir, "customer"), "c_custkey", 20).select("c_custkey")


@query("p4_cohort_status", "SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN 'NO_PROVIDER' WHEN c_acctbal < 0 THEN 'EXPIRED' WHEN NOT (c_nationkey BETWEEN 2 AND 20) THEN 'OUT_OF_AREA' WHEN c_acctbal BETWEEN 0 AND 100 THEN 'GRACE' ELSE 'ELIGIBLE' END AS status FROM customer")
def p4(spark, sf_dir):
    s = F.when(F.col("c_mktsegment").isNull(), "NO_PROVIDER").when(F.col("c_acctbal") < 0, "EXPIRED").when(~F.col("c_nationkey").between(2, 20), "OUT_OF_AREA").when(F.col("c_acctbal").between(0, 100), "GRACE").otherwise("ELIGIBLE")
    return table(spark, sf_dir, "customer").select("c_custkey", s.alias("status"))


@query("s5_violations", "SELECT 'acctbal' AS rule, count(*) FILTER (NOT coalesce(c_acctbal > -999, false)) AS n FROM customer UNION ALL SELECT 'nation', count(*) FILTER (NOT coalesce(c_nationkey BETWEEN 0 AND 24, false)) FROM customer UNION ALL SELECT 'one_c_name', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_name) > 1)")
def s5(spark, sf_dir):
    return tables.violations(table(spark, sf_dir, "customer"), "c_custkey", {"acctbal": F.col("c_acctbal") > -999, "nation": F.col("c_nationkey").between(0, 24)}, single=("c_name",))


@query("k2_revision_merge", """WITH old AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, 1 + o_orderkey % 3 AS revision FROM orders WHERE o_orderkey % 7 <> 0)
SELECT n.o_orderkey, n.o_orderstatus, n.o_orderpriority, (CASE WHEN old.revision IS NULL THEN 1 WHEN n.o_orderstatus IS NOT DISTINCT FROM old.o_orderstatus AND n.o_orderpriority IS NOT DISTINCT FROM old.o_orderpriority THEN old.revision ELSE old.revision + 1 END)::BIGINT AS revision FROM orders n LEFT JOIN old USING (o_orderkey)""")
def k2(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority", (F.col("o_orderkey") % 3 + 1).alias("revision"))
    return tables.revised(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), old, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("u2_set_ops", "SELECT 'both' AS kind, c_nationkey::BIGINT AS k FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer_only', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', c_nationkey FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def u2(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    named = lambda df, name: df.select(F.lit(name).alias("kind"), "k")
    return named(c.intersect(s), "both").unionByName(named(c.subtract(s), "customer_only")).unionByName(named(c.union(s).distinct(), "any"))


@query("o2_top_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25")
def o2(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.col("p_retailprice").desc_nulls_last(), "p_partkey").limit(25).select("p_partkey", "p_retailprice")


@query("o3_worst_first", "SELECT s_suppkey, s_acctbal < 0 AS poor, s_acctbal FROM supplier ORDER BY CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END, s_acctbal, s_suppkey LIMIT 20")
def o3(spark, sf_dir):
    return table(spark, sf_dir, "supplier").orderBy(F.when(F.col("s_acctbal") < 0, 0).otherwise(1), "s_acctbal", "s_suppkey").limit(20).select("s_suppkey", (F.col("s_acctbal") < 0).alias("poor"), "s_acctbal")


@query("o4_argmax", "SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_mktsegment, c_custkey) AS n FROM customer) WHERE n = 1")
def o4(spark, sf_dir):
    return identity.latest(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_mktsegment"), F.asc("c_custkey")]).select(F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_custkey")


@query("f_strings", r"""SELECT p_partkey, upper(trim(p_name)) AS f1, nullif(p_brand, 'Brand#11') AS f2, left(p_type, 3) AS f3, substr(p_name, 3, 4) AS f4, p_brand || '|' || p_type AS f5, length(p_name)::BIGINT AS f6, lpad(p_partkey::VARCHAR, 8, '0') AS f7,
regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS f8, regexp_matches(p_type, '[AEIOU]{2}') AS f9, (length(p_name) - length(replace(p_name, 'e', '')))::BIGINT AS f10, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS f11, p_type ILIKE '%steel%' AS f12,
regexp_full_match(p_brand, 'Brand#[0-9]+') AS f13, sha256(p_name) AS f15, try_cast(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS f18 FROM part""")
def f_strings(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(F.trim("p_name")).alias("f1"), F.nullif("p_brand", F.lit("Brand#11")).alias("f2"), F.left("p_type", F.lit(3)).alias("f3"), F.substring("p_name", 3, 4).alias("f4"), F.concat("p_brand", F.lit("|"), "p_type").alias("f5"),
        F.length("p_name").cast("long").alias("f6"), F.lpad(c("p_partkey").cast("string"), 8, "0").alias("f7"), F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("f8"), c("p_type").rlike("[AEIOU]{2}").alias("f9"), F.regexp_count("p_name", F.lit("e")).cast("long").alias("f10"),
        F.regexp_substr("p_brand", F.lit("[0-9]+")).alias("f11"), c("p_type").ilike("%steel%").alias("f12"), c("p_brand").rlike("^Brand#[0-9]+$").alias("f13"), F.sha2("p_name", 256).alias("f15"), F.regexp_substr("p_brand", F.lit("[0-9]+")).try_cast("double").alias("f18"),
    )


@query("f_dates", """SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS f19, o_orderdate + INTERVAL 36 HOUR AS f20, date_sub('hour', TIMESTAMP '1992-01-01 00:30:00', o_orderdate)::BIGINT AS f21, date_part('day', o_orderdate)::BIGINT AS f22, (isodow(o_orderdate) - 1)::BIGINT AS f23,
o_orderdate + INTERVAL 330 MINUTE AS f24, o_orderdate::DATE AS f27, greatest(o_orderkey % 5, o_custkey % 7) AS f38, sign(o_totalprice - 100000)::INT AS f39, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f40, floor(o_totalprice / 1000)::BIGINT AS f33, ceil(o_totalprice / 1000)::BIGINT AS f33b FROM orders""")
def f_dates(spark, sf_dir):
    c, e = F.col, F.expr
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("f19"), (c("o_orderdate") + e("INTERVAL 36 HOURS")).alias("f20"), e("timestampdiff(HOUR, timestamp_ntz'1992-01-01 00:30:00', o_orderdate)").alias("f21"), F.dayofmonth("o_orderdate").cast("long").alias("f22"),
        F.weekday("o_orderdate").cast("long").alias("f23"), F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), "o_orderdate").alias("f24"), F.to_date("o_orderdate").alias("f27"), F.greatest(c("o_orderkey") % 5, c("o_custkey") % 7).alias("f38"), F.signum(c("o_totalprice") - 100000).cast("int").alias("f39"),
        F.when(c("o_orderstatus") == "F", 1).otherwise(0).alias("f40"), F.floor(c("o_totalprice") / 1000).alias("f33"), F.ceil(c("o_totalprice") / 1000).alias("f33b"),
    )


@query("f_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def f_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("f44_json_leaves", "SELECT event_id, 'k' AS leaf, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def f44(spark, sf_dir):
    """Every leaf of a flat tree as a row."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("leaf", "value"))


#: An order as a document: objects and arrays within each other.
TREES = "tr AS (SELECT o_orderkey, to_json({'order': o_orderkey, 'meta': {'status': o_orderstatus, 'more': {'priority': o_orderpriority, 'clerk no': CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END}}, 'lines': lines}) AS j FROM orders JOIN (SELECT l_orderkey, list({'n': l_linenumber, 'part': l_partkey, 'flags': [l_returnflag, l_linestatus]} ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def trees(spark, sf_dir):
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.array("l_returnflag", "l_linestatus").alias("flags"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("x")))).alias("l"))
    more = F.struct(F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("clerk no"))
    whole = F.struct(F.col("o_orderkey").alias("order"), F.struct(F.col("o_orderstatus").alias("status"), more.alias("more")).alias("meta"), F.col("l.x").alias("lines"))
    return table(spark, sf_dir, "orders").join(rows, "o_orderkey").select("o_orderkey", F.to_json(whole, {"ignoreNullFields": "false"}).alias("j"))


@query("f44_leaves", f"WITH {TREES} SELECT o_orderkey, t.fullkey AS path, json_extract_string(t.value, '$') AS value FROM tr, json_tree(tr.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')")
def f44_deep(spark, sf_dir):
    return leaves.leaves(trees(spark, sf_dir), ["o_orderkey"], "j")


@query("f43_wildcards", f"""WITH {TREES} SELECT o_orderkey, t.fullkey AS path, json_extract_string(t.value, '$') AS value FROM tr, json_tree(tr.j) t WHERE regexp_full_match(t.fullkey, '\\$\\.lines\\[[0-9]+\\]\\.flags\\[1\\]')
UNION ALL SELECT o_orderkey, t.fullkey, json_extract_string(t.value, '$') FROM tr, json_tree(tr.j) t WHERE regexp_full_match(t.fullkey, '\\$\\.meta\\.[a-z]+\\."clerk no"')""")
def f43_wild(spark, sf_dir):
    x = trees(spark, sf_dir)
    return leaves.at_path(x, ["o_orderkey"], "j", "$.lines[*].flags[1]").unionByName(leaves.at_path(x, ["o_orderkey"], "j", '$.meta.*["clerk no"]'))


@query("f45_leaf_reducers", "SELECT vec_id, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive, list_sort(embedding)[33]::DOUBLE AS middle FROM embeddings")
def f45(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_min(e).cast("double").alias("lo"), F.array_max(e).cast("double").alias("hi"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.get(F.array_sort(e), F.lit(32)).cast("double").alias("middle"))


@query("p19_calendar", "SELECT event_id, sin(2 * pi() * hour(ts) / 24)::DECIMAL(18,9) AS hour_sin, cos(2 * pi() * hour(ts) / 24)::DECIMAL(18,9) AS hour_cos, sin(2 * pi() * (isodow(ts) - 1) / 7)::DECIMAL(18,9) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7)::DECIMAL(18,9) AS dow_cos, ln(1 + abs(value))::DECIMAL(18,6) AS log_value, least(date_diff('day', DATE '2024-01-01', ts::DATE), 21)::BIGINT AS elapsed FROM events")
def p19(spark, sf_dir):
    """Angles go to nine decimals, so that the last bit of a library's sine doesn't count."""
    angle = lambda x, n: 2 * F.pi() * x / n
    nine = lambda x: (x + F.lit(0.0)).cast("decimal(18,9)")
    h, d = F.hour("ts"), F.weekday("ts")
    return table(spark, sf_dir, "events").select("event_id", nine(F.sin(angle(h, 24))).alias("hour_sin"), nine(F.cos(angle(h, 24))).alias("hour_cos"), nine(F.sin(angle(d, 7))).alias("dow_sin"), nine(F.cos(angle(d, 7))).alias("dow_cos"), F.log1p(F.abs("value")).cast("decimal(18,6)").alias("log_value"), F.least(F.datediff("ts", F.lit("2024-01-01")), F.lit(21)).cast("long").alias("elapsed"))


@query("s12_catalog", "SELECT column_name AS name, data_type ILIKE '%char%' AS is_text FROM information_schema.columns WHERE table_name = 'events' AND regexp_matches(column_name, '(^|_)(id|ts|type)($|_)')")
def s12(spark, sf_dir):
    rows = [(f.name, f.dataType.typeName() == "string") for f in table(spark, sf_dir, "events").schema.fields]
    return spark.createDataFrame(rows, "name string, is_text boolean").where(F.col("name").rlike("(^|_)(id|ts|type)($|_)"))


@query("s14_values_join", "SELECT v.minutes, count(*) AS n FROM (VALUES (0), (15), (30), (45)) v(minutes) JOIN events ON minute(ts) // 15 * 15 = v.minutes GROUP BY 1")
def s14(spark, sf_dir):
    v = spark.createDataFrame([(0,), (15,), (30,), (45,)], "minutes int")
    return table(spark, sf_dir, "events").withColumn("minutes", F.expr("int(minute(ts) div 15 * 15)")).join(F.broadcast(v), "minutes").groupBy("minutes").agg(F.count("*").alias("n"))
