"""Hourly telemetry: repair and validity of rows, spines with misses, quarter-hour states, triggers, cascade labels.

A row is one device and hour with `bitmap`, twelve characters of 0 or 1, one for each five minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timeline import seconds

#: Fixed value: an hour without a ping.
MISSED = "0" * 12


def later(at: Column | str, hours: int = 0, minutes: int = 0) -> Column:
    return (F.col(at) if isinstance(at, str) else at) + F.expr(f"INTERVAL {hours * 60 + minutes} MINUTES")


def effective_end(start: str, end: str) -> Column:
    """The end of an hour: one hour on; an end that says the midnight before is read as the one after; any other is null."""
    midnight = F.date_trunc("day", start).cast("timestamp_ntz")
    whole = F.col(end) == later(start, 1)
    written_as_day = (F.hour(start) == 23) & (F.col(end) == midnight)
    return F.when(whole | written_as_day, later(start, 1))


def invalid(received: str, first: str, last: str, start: str, end: Column) -> Column:
    """Whether a row contradicts itself: no end, no or a negative count, ends of pings where there are none, or outside the hour."""
    n, a, b = F.col(received), F.col(first), F.col(last)
    none_but_times = (n == 0) & (a.isNotNull() | b.isNotNull())
    outside = a.isNull() | b.isNull() | (a < F.col(start)) | (a >= end) | (b < a) | (b >= end)
    return F.coalesce(end.isNull() | n.isNull() | (n < 0) | none_but_times | ((n > 0) & outside), F.lit(True))


def optics(least: str, mean: str, most: str) -> Column:
    """The mean of a power reading in dBm if least <= mean <= most, from -50 on and below 0; else null."""
    a, m, b = F.col(least), F.col(mean), F.col(most)
    return F.when((a >= -50) & (a <= m) & (m <= b) & (b < 0), m)


def with_misses(roster: DataFrame, hours: DataFrame, start: str, end: str, device: str = "device") -> DataFrame:
    """Every device of the roster in every hour from start to end: an absent hour is twelve misses, and not a bad one.

    Both sides grow with the fleet, but are planned by the size of the files that they are made of, so the join is named.
    """
    every = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR"))
    x = roster.withColumn("hour", F.explode(every)).join(hours.select(device, "hour", "bitmap", "bad").hint("merge"), [device, "hour"], "left")
    return x.withColumns({"bitmap": F.coalesce("bitmap", F.lit(MISSED)), "bad": F.coalesce("bad", F.lit(0))})


def quarter_states(hours: DataFrame, device: str = "device") -> DataFrame:
    """(all of hours, anchor, early, outage, state_bad) at the end of each quarter of an hour; needs the hour before.

    outage: no ping in the last 60 minutes; early: none in the last 15, but some in the last 60.
    """
    w = Window.partitionBy(device).orderBy("hour")
    x = hours.withColumns({"_before": F.lag("bitmap").over(w), "_bad": F.lag("bad").over(w), "_then": F.lag("hour").over(w)})
    x = x.where(F.col("_then") == later("hour", -1)).withColumn("q", F.explode(F.array(*map(F.lit, range(4)))))
    both = F.concat("_before", "bitmap")
    sixty = both.substr(3 * F.col("q") + 4, F.lit(12)) == MISSED
    fifteen = F.col("bitmap").substr(3 * F.col("q") + 1, F.lit(3)) == "000"
    bad = F.when(F.col("q") == 3, F.col("bad")).otherwise(F.greatest("_bad", "bad"))
    anchor = F.col("hour") + F.make_dt_interval(mins=15 * (F.col("q") + 1))
    return x.select(*hours.columns, anchor.alias("anchor"), (fifteen & ~sixty).alias("early"), sixty.alias("outage"), bad.alias("state_bad"))


def cell_states(states: DataFrame, cell: str = "cell", least: int = 20) -> DataFrame:
    """(cell, anchor, eligible, early, outage, bad): counts of devices, for cells with `least` of them or more."""
    n = lambda c, name: F.count_if(c).alias(name)
    x = states.groupBy(cell, "anchor").agg(F.count("*").alias("eligible"), n("early", "early"), n("outage", "outage"), n(F.col("state_bad") == 1, "bad"))
    return x.where(F.col("eligible") >= least)


def triggers(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """States in which a tenth of a cell misses early, fewer are out, no row is bad, and that was not so in the 60 minutes before."""
    tenth = F.ceil(F.col("eligible") / 10)
    raw = (F.col("bad") == 0) & (F.col("early") >= tenth) & (F.col("outage") < tenth)
    w = Window.partitionBy(cell).orderBy("_s").rangeBetween(-3600, -1)
    x = cells.withColumn("_raw", raw.cast("int")).withColumn("_s", seconds("anchor"))
    return x.withColumn("_p", F.max("_raw").over(w)).where("_raw = 1 AND coalesce(_p, 0) = 0").drop("_raw", "_s", "_p")


def cascades(found: DataFrame, hours: DataFrame, device: str = "device", cell: str = "cell") -> DataFrame:
    """(cell, anchor, eligible, cascade, warning_minutes) for each trigger whose next hour is known whole.

    cascade: at one of the twelve checkpoints of the next hour 70 % of the devices have had no ping for 60 minutes.
    Triggers are joined to the hours of their cell by (cell, hour); each device brings three hours, so a checkpoint is a piece
    of a string.
    """
    w = Window.partitionBy(device).orderBy("hour")
    three = hours.withColumns({"_p": F.lag("bitmap").over(w), "_n": F.lead("bitmap").over(w), "_pb": F.lag("bad").over(w), "_nb": F.lead("bad").over(w)})
    three = three.where("_p IS NOT NULL AND _n IS NOT NULL")
    three = three.select(cell, "hour", F.concat("_p", "bitmap", "_n").alias("_bits"), F.greatest("_pb", "bad", "_nb").alias("_any_bad"))
    at = found.withColumn("hour", F.date_trunc("hour", "anchor").cast("timestamp_ntz"))
    x = at.join(three, [cell, "hour"]).withColumn("k", F.explode(F.array(*map(F.lit, range(1, 13)))))
    start = 1 + F.floor(F.minute("anchor") / 5).cast("int") + F.col("k")
    out = F.col("_bits").substr(start, F.lit(12)) == MISSED
    keys = [cell, "anchor", "eligible"]
    x = x.groupBy(*keys, "k").agg(F.count("*").alias("seen"), F.max("_any_bad").alias("bad"), F.count_if(out).alias("out"))
    enough = F.col("out") * 10 >= F.col("eligible") * 7
    x = x.groupBy(*keys).agg(F.max(enough).alias("cascade"), F.min(F.when(enough, F.col("k") * 5)).alias("warning_minutes"), F.count("*").alias("n"), F.min("seen").alias("lo"), F.max("seen").alias("hi"), F.max("bad").alias("bad"))
    return x.where("n = 12 AND lo = eligible AND hi = eligible AND bad = 0").select(*keys, "cascade", "warning_minutes")
