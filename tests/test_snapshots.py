"""A stream's snapshots: once a tick, checked, the last good one stays."""

import tempfile

from pyspark.sql import functions as F

from quietline.sources import feeds, tables
from quietline.streaming import snapshots


def check(df):
    return tables.violations(df, "provider", {"positive": F.col("n") > 0})


def test_ticks(spark):
    root = tempfile.mkdtemp(prefix="spark-test-") + "/snap"
    one = spark.createDataFrame([(1, 5)], "provider long, n long")
    assert snapshots.put(one, 1, root, check) == "OK"
    assert snapshots.put(spark.createDataFrame([(1, 0)], one.schema), 2, root, check) == "REFUSED"
    assert feeds.newest(spark, root).collect() == one.collect()
    assert snapshots.put(one, 1, root, check) == "STALE" and snapshots.put(one, 0, root, check) == "STALE"
    two = spark.createDataFrame([(2, 7)], one.schema)
    assert snapshots.put(two, 2, root, check) == "OK"
    assert feeds.newest(spark, root).collect() == two.collect()
    assert sorted(r.version for r in snapshots.ticks(one, root).collect()) == [1, 2]


def test_stream(spark):
    folder = tempfile.mkdtemp(prefix="spark-test-")
    schema = "provider long, down boolean"
    for k, rows in enumerate(([(1, True), (1, False)], [(1, False)], [(2, True), (1, True), (1, True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/part={k}")
    rows = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    make = lambda b: b.groupBy("provider").agg(F.count_if("down").alias("n"))
    for _ in range(2):  # the second finds nothing new
        snapshots.stream(rows, make, f"{folder}/out", check, f"{folder}/log").awaitTermination()
    done = {r.version for r in snapshots.ticks(rows, f"{folder}/out").collect()}
    # The batch without a device that is down is refused; three came, so two are there.
    assert len(done) == 2
    assert feeds.newest(spark, f"{folder}/out").where("n > 0").count() > 0
