"""Time-series operators: device hours, spines, gaps, episodes, anchored groups, strictly-prior features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hour_of(ts: Column | str) -> Column:
    """The hour of a timestamp without zone, as one (date_trunc gives a zoned one)."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, in UTC."""
    return F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def device_hours(events: DataFrame, device: str = "user_id", failed: Column | None = None) -> DataFrame:
    """(device, hour, n, errors, first_ts, last_ts, cents): one row a device and hour that has events."""
    failed = F.col("event_type") == "error" if failed is None else failed
    return events.groupBy(device, hour_of("ts").alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    )


def running_bad(hours: DataFrame, bad: Column, device: str = "user_id") -> DataFrame:
    """Adds `bad_so_far`: bad hours of the device up to and including this one."""
    w = Window.partitionBy(device).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hours.withColumn("bad_so_far", F.sum(bad.cast("long")).over(w))


def bad_hours_so_far(events: DataFrame, failed: Column, device: str = "user_id") -> DataFrame:
    """Adds `bad_so_far` to each event: hours of the device with a failure, up to and including its own hour as a whole.

    The first failure of an hour stands for it, so one shuffle by device does; hours aren't built and joined back.
    """
    w = Window.partitionBy(device)
    x = events.withColumn("_hour", hour_of("ts"))
    last = F.max(F.when(failed, F.col("_hour"))).over(w.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", (failed & ~F.coalesce(last == F.col("_hour"), F.lit(False))).cast("long"))
    upto = w.orderBy("_hour").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("bad_so_far", F.sum("_new").over(upto)).drop("_hour", "_new")


def gaps(successes: DataFrame, end: str, step: str, least_s: int, device: str = "user_id", carry: str | None = None) -> DataFrame:
    """Outages between neighbouring successes at least `least_s` seconds apart, and open ones against `end`.

    (device, start, stop, censored, seconds[, crossed]): start is `step` after the last success. With `carry`, a running count
    on the successes, crossed says whether it differs at both ends; open gaps compare with the device's last count.
    """
    w = Window.partitionBy(device).orderBy("ts", "event_id")
    x = successes.withColumn("next", F.lead("ts").over(w))
    stop, limit = F.coalesce("next", F.lit(end).cast("timestamp_ntz")), F.lit(least_s)
    x = x.withColumn("stop", stop).withColumn("gap_s", seconds("stop") - seconds("ts")).withColumn("censored", F.col("next").isNull())
    if carry:
        last = Window.partitionBy(device).orderBy("ts", "event_id")
        x = x.withColumn("crossed", F.coalesce(F.lead(carry).over(last), F.col(carry)) != F.col(carry))
    return x.where(F.col("gap_s") >= limit).select(device, (F.col("ts") + F.expr(f"INTERVAL {step}")).alias("start"), "stop", "censored", F.col("gap_s").alias("seconds"), *(["crossed"] * bool(carry)))


def episodes(intervals: DataFrame, within_s: int, device: str = "user_id") -> DataFrame:
    """Merge intervals (start, stop) of a device whose distance from all before is at most `within_s`: (device, start, stop, n)."""
    w = Window.partitionBy(device).orderBy("start", "stop")
    until = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = intervals.withColumn("fresh", F.when(until.isNull() | (seconds("start") - seconds(until) > within_s), 1).otherwise(0))
    x = x.withColumn("episode", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(device, "episode").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"))


def anchored(df: DataFrame, key: str, at: str, ident: str, window_s: int) -> DataFrame:
    """(key, at, id, anchor): rows in groups that a first row opens; a row joins while it is at most `window_s` after it.

    Neither a tumbling nor a session window: each group's border depends on where the one before began. Rows stream through a
    task in order of key and time, and what it keeps is one anchor, so a key of any size takes one pass.
    """
    kinds = dict(df.dtypes)
    rows = df.select(key, at, ident, F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    ordered = rows.repartition(key).sortWithinPartitions(key, at, ident)

    def fold(batches):
        last, anchor = object(), None
        for b in batches:
            us, keys = b["_us"].to_numpy(), b[key].dictionary_encode()
            codes, names = keys.indices.to_numpy(zero_copy_only=False), keys.dictionary
            heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else []
            out = np.empty(len(us), np.int64)
            for i, j in zip(heads, [*heads[1:], len(us)], strict=True):
                name = names[codes[i]].as_py()
                anchor = anchor if name == last else None
                last = name
                while i < j:
                    if anchor is None or us[i] // 1_000_000 - anchor // 1_000_000 > window_s:
                        anchor = us[i]
                    # All rows to the end of the window's last second.
                    k = i + int(np.searchsorted(us[i:j], (anchor // 1_000_000 + window_s + 1) * 1_000_000))
                    out[i:k], i = anchor, k
            yield pa.RecordBatch.from_arrays([b[key], b[at], b[ident], pa.array(out)], names=[key, at, ident, "_us"])

    done = ordered.where(F.col(key).isNotNull()).mapInArrow(fold, f"{key} {kinds[key]}, {at} {kinds[at]}, {ident} {kinds[ident]}, _us long")
    return done.select(key, at, ident, F.timestamp_micros("_us").cast(kinds[at]).alias("anchor"))


def spine(keys: DataFrame, start: str, end: str, step: str, name: str) -> DataFrame:
    """Every key with every time from start to end, both included."""
    times = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"INTERVAL {step}"))
    return keys.withColumn(name, F.explode(times))


def over_days(intervals: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """Half-open intervals by each day that they overlap: an equality join then takes the place of a range join."""
    first, last = F.to_date(start), F.to_date(F.col(stop) - F.expr("INTERVAL 1 SECOND"))
    return intervals.where(F.col(stop) > F.col(start)).withColumn("day", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY"))))


def strictly_prior(anchors: DataFrame, rows: DataFrame, device: str, at: str, ts: str, value: str, tolerance_s: int) -> DataFrame:
    """`anchors` with the value and time of the latest row strictly before, at most `tolerance_s` earlier (else null).

    One sort of both on one timeline: anchors come before rows at the same time, so equality doesn't match.
    """
    a = anchors.select(device, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(dict(rows.dtypes)[value]).alias("_v"), F.lit(None).cast("timestamp_ntz").alias("_at"), F.lit(None).cast("long").alias("_id"))
    r = rows.select(device, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.col(value).alias("_v"), F.col(ts).alias("_at"), F.col("event_id").cast("long").alias("_id"))
    w = Window.partitionBy(device).orderBy("_t", "_side", "_id").rowsBetween(Window.unboundedPreceding, -1)
    x = a.unionByName(r).withColumn("p", F.last(F.when(F.col("_side") == 1, F.struct("_v", "_at")), ignorenulls=True).over(w)).where("_side = 0")
    near = seconds("_t") - seconds("p._at") <= tolerance_s
    return x.select(device, F.col("_t").alias(at), F.when(near, F.col("p._v")).alias("prior_value"), F.when(near, F.col("p._at")).alias("prior_at"))


def rolling(events: DataFrame, hours: tuple[int, ...], device: str = "user_id") -> DataFrame:
    """Adds n_{h}h: events of the device in [ts - h, ts), by ranges over seconds."""
    x = events.withColumn("_s", seconds("ts"))
    for h in hours:
        x = x.withColumn(f"n_{h}h", F.count("*").over(Window.partitionBy(device).orderBy("_s").rangeBetween(-h * 3600, -1)))
    return x.drop("_s")


def strongest(events: DataFrame, window_s: int, device: str = "user_id") -> DataFrame:
    """(device, most): the largest number of events in any window that ends at one, both ends included."""
    w = Window.partitionBy(device).orderBy("_s").rangeBetween(-window_s, 0)
    return events.withColumn("_s", seconds("ts")).withColumn("c", F.count("*").over(w)).groupBy(device).agg(F.max("c").alias("most"))
