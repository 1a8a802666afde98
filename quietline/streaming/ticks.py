"""The detector's outages as a stream: each due tick is evaluated once, over tables in a shared folder.

A micro-batch of device runs is added to the runs so far. Then every tick that it completes is evaluated in order: what has
recovered or aged closes, then what has failed opens, and last a receipt for each provider is written. A tick with receipts is
never evaluated again, and what a crash left of one without receipts gives way, so a retry adds nothing. A tick whose turn comes
too late is skipped and gets a receipt that says so. Each step is joins and sums over partial aggregates by device and provider.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import detector

OPEN = "provider long, opened timestamp_ntz, kind string, size long, base long, device long, first_fail_at timestamp_ntz"
CLOSED = "provider long, opened timestamp_ntz, closed_at timestamp_ntz, close_reason string"
LEDGER = "provider long, tick timestamp_ntz, result string"
STEP = dt.timedelta(seconds=detector.TICK_S)


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the folder; empty before its first part is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.option("recursiveFileLookup", True).schema(schema).parquet(f"{root}/{name}")


def _write(df: DataFrame, root: str, name: str, part: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/{part}")


def members(spark: SparkSession, root: str) -> DataFrame:
    """Members of every outage, with when it was closed and why."""
    return read(spark, root, "opened", OPEN).join(read(spark, root, "closed", CLOSED), ["provider", "opened"], "left")


def evaluate(spark: SparkSession, root: str, tick: dt.datetime, evaluated_at: dt.datetime, cap_min: int = detector.CAP_MIN, mass_percent: int | None = None) -> None:
    """One tick: closings, openings, receipts. With `mass_percent`, nothing opens while more of the fleet than that fails."""
    part = tick.strftime("%Y%m%d%H%M")
    now = F.lit(tick).cast("timestamp_ntz")
    runs = read(spark, root, "runs", detector.RUNS).where(F.col("ts") <= now)
    late = evaluated_at - tick > dt.timedelta(seconds=detector.STALE_S)
    still = members(spark, root).where("closed_at IS NULL AND opened < " + f"timestamp_ntz'{tick}'")
    opened = None
    if not late:
        if not still.isEmpty():
            back = detector.recoveries(runs).where(F.col("recovered_at") <= now).select("device", F.col("run_start").alias("_run"))
            hit = F.col("_run") > F.col("first_fail_at") - F.expr("INTERVAL 5 MINUTES")
            who = still.join(back, "device", "left").groupBy("provider", "opened", "size", "device").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("back"))
            of = who.groupBy("provider", "opened", "size").agg(F.count_if("back").alias("n"))
            aged = F.col("opened") + F.expr(f"INTERVAL {cap_min} MINUTES") <= now
            well = F.col("n") * 10 >= F.col("size") * 9
            done = of.where(well | aged).select("provider", "opened", now.alias("closed_at"), F.when(well, "RECOVERED").otherwise("AGE_CAP").alias("close_reason"))
            _write(done, root, "closed", part)
            still = members(spark, root).where("closed_at IS NULL AND opened < " + f"timestamp_ntz'{tick}'")
        if tick.minute % 10 == 0 or tick.minute % 15 == 0:
            opened = detector.evaluate_tick(runs, still, tick)
            if mass_percent is not None:
                paused = detector.paused_ticks(runs, mass_percent).where("paused").where(F.col("tick") == now)
                opened = opened.join(paused.select(F.col("tick").alias("opened")), "opened", "left_anti").select(*(c.split()[0] for c in OPEN.split(", ")))
            _write(opened, root, "opened", part)
            opened = read(spark, root, "opened", OPEN).where(F.col("opened") == now).select("provider", "opened").distinct()
    found = opened if opened is not None else spark.createDataFrame([], "provider long, opened timestamp_ntz")
    one = spark.createDataFrame([(tick, evaluated_at)], "tick timestamp_ntz, evaluated_at timestamp_ntz")
    _write(detector.receipts(runs, one, found), root, "ledger", part)


def advance(batch: DataFrame, number: int, root: str, clock=None, **rules) -> None:
    """Adds a batch of runs and evaluates the ticks that it completes: those before its latest message.

    `clock(tick)` says when a tick is evaluated, by default on time; a replay isn't late.
    """
    spark = batch.sparkSession
    _write(batch, root, "runs", f"batch={number}")
    first, last = read(spark, root, "runs", detector.RUNS).agg(F.min("ts"), F.max("ts")).first()
    if last is None:
        return
    done = read(spark, root, "ledger", LEDGER).agg(F.max("tick")).first()[0]
    tick = done + STEP if done else first - (first - dt.datetime(first.year, first.month, first.day)) % STEP
    while tick < last:
        evaluate(spark, root, tick, clock(tick) if clock else tick, **rules)
        tick += STEP


def stream(runs: DataFrame, root: str, checkpoint: str, **rules) -> StreamingQuery:
    """Outages of a stream of device runs, below `root`; its folder must be one that all executors share."""
    write = runs.writeStream.outputMode("append").foreachBatch(lambda batch, number: advance(batch, number, root, **rules))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
