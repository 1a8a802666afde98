"""Outages from silence: device runs as a stream or as a batch, then ticks that open and close outages of a provider.

A message has device, provider, ts and up. Per device, a message no later than the last one kept is dropped, whatever its
order of arrival. A run of successes ends at a failure or at 10 minutes without a success. A device has recovered once its run
holds 3 successes and is 15 minutes old, whether or not a message comes then. Silence is failure: 10 minutes after the last
success a device counts for the large check (every 10 minutes), after 15 for the small one (every 15), and up to 30 for either.
Every edge counts.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

RUNS = "device long, provider long, ts timestamp_ntz, up boolean, last_up_at timestamp_ntz, run_start timestamp_ntz, run_count long"
#: Fixed values, in seconds, minutes and devices.
SILENT_S, RECOVERED_S, RECOVERED_N = 600, 900, 3
TICK_S, CAP_MIN, BASE_H, STALE_S = 300, 21_600, 24, 300
BIG, SMALL, FLOOR, TIERS = 26, 10, 3, (101, 26, 10, 3)
#: State of a device that is silent for longer than the age cap and a day goes.
STATE_DAYS = 16


def _us(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _at(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def next_tick(us: Column) -> Column:
    """The first tick at or after a time, both in microseconds."""
    return F.ceil(us / (TICK_S * 1_000_000)).cast("long") * (TICK_S * 1_000_000)


def device_runs(messages: DataFrame, arrival: str) -> DataFrame:
    """RUNS of a whole table of messages that came in order of `arrival`; windows by device alone."""
    by = Window.partitionBy("device")
    came = by.orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("ts").over(came)
    x = messages.withColumn("_latest", latest).where("_latest IS NULL OR ts > _latest").drop("_latest")
    so_far = by.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    before = by.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("last_up_at", F.max(F.when(F.col("up"), F.col("ts"))).over(so_far)).withColumn("_prev", F.max(F.when(F.col("up"), F.col("ts"))).over(before)).withColumn("_failed", F.lag(~F.col("up")).over(by.orderBy("ts")))
    begins = F.col("up") & (F.col("_prev").isNull() | F.col("_failed") | (_us("ts") - _us("_prev") >= SILENT_S * 1_000_000))
    x = x.withColumn("_run", F.sum(begins.cast("int")).over(so_far))
    in_run = Window.partitionBy("device", "_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("run_start", F.when(F.col("up"), F.min(F.when(F.col("up"), F.col("ts"))).over(in_run))).withColumn("run_count", F.when(F.col("up"), F.count_if("up").over(in_run)).otherwise(0))
    return x.select("device", "provider", "ts", "up", "last_up_at", "run_start", "run_count")


def recovered() -> Column:
    """Whether a message of RUNS finds its device recovered: a success of a run that holds 3 and is 15 minutes old."""
    old = _us("ts") - _us("run_start") >= RECOVERED_S * 1_000_000
    return F.coalesce(F.col("up") & (F.col("run_count") >= RECOVERED_N) & old, F.lit(False))


class Runs(StatefulProcessor):
    """Folds a device's messages over four values of state, which expire when nothing is heard of it for STATE_DAYS."""

    def __init__(self, arrival: str):
        self.arrival = arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = ("seen", "last_up", "start", "n")
        kind = StructType([StructField(c, LongType()) for c in names])
        self.state = handle.getValueState("run", kind, ttlDurationMs=STATE_DAYS * 86_400_000)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        seen, last_up, start, n = self.state.get() if self.state.exists() else (None, None, None, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(self.arrival).itertuples():
            at = int(r.ts.value // 1000)
            if seen is not None and at <= seen:
                continue
            seen = at
            if r.up:
                if start is None or at - last_up >= SILENT_S * 1_000_000:
                    start, n = at, 0
                n, last_up = n + 1, at
            else:
                start, n = None, 0
            out.append((r.device, r.provider, at, bool(r.up), last_up, start, n))
        self.state.update((seen, last_up, start, n))
        pdf = pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")])
        for c in ("ts", "last_up_at", "run_start"):
            pdf[c] = pd.to_datetime(pdf[c], unit="us")
        yield pdf

    def close(self) -> None:
        pass


def stream_runs(messages: DataFrame, arrival: str) -> DataFrame:
    """RUNS of a stream by the same rules. Late messages are dropped by them, without a watermark.

    The session's state store must be RocksDB's (`spark.sql.streaming.stateStore.providerClass`), as state has a lifetime. A
    run that should end with its input needs `spark.sql.streaming.noDataMicroBatches.enabled` off: lifetimes are looked after in
    batches without data, which never end.
    """
    return messages.groupBy("device").transformWithStateInPandas(Runs(arrival), outputStructType=RUNS, outputMode="Append", timeMode="ProcessingTime")


def recoveries(runs: DataFrame) -> DataFrame:
    """(device, provider, run_start, recovered_at) of the runs that recover their device.

    The time is when the run is 15 minutes old and has its third success, unless a failure, or 10 minutes without a success,
    breaks it before or just then.
    """
    order = Window.partitionBy("device").orderBy("ts")
    fails = F.when(~F.lead("up").over(order), F.lead("ts").over(order))
    x = runs.withColumn("_fails", fails).where("up").groupBy("device", "run_start")
    x = x.agg(F.max(F.struct("ts", "provider", "_fails")).alias("last"), F.max(F.when(F.col("run_count") == RECOVERED_N, F.col("ts"))).alias("third"))
    at = F.greatest(_us("run_start") + RECOVERED_S * 1_000_000, _us("third"))
    broken = F.least(_us("last.ts") + SILENT_S * 1_000_000, _us("last._fails"))
    return x.where(F.col("third").isNotNull() & (at < broken)).select("device", "last.provider", "run_start", _at(at).alias("recovered_at"))


def silent(runs: DataFrame, end: str) -> DataFrame:
    """(provider, tick, device, big, small, last_up_at, back_at): devices that are silent at a tick, some ticks of each silence.

    Each last success reaches the ticks of the half hour after it that come before the next success, so no table of ticks is
    joined. back_at is when the device next recovers, if it does.
    """
    by = Window.partitionBy("device").orderBy("ts")
    back = recoveries(runs).select("device", F.col("run_start").alias("ts"), "recovered_at")
    ups = runs.where("up").join(back, ["device", "ts"], "left")
    ups = ups.withColumn("back_at", F.min("recovered_at").over(by.rowsBetween(1, Window.unboundedFollowing))).withColumn("_next", F.lead("ts").over(by))
    last = F.lit(end).cast("timestamp_ntz")
    stop = F.least(F.coalesce(F.col("_next") - F.expr("INTERVAL 1 MICROSECOND"), last), F.col("ts") + F.expr("INTERVAL 30 MINUTES"), last)
    first = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    ticks = F.explode(F.expr("sequence(_hour, _hour + INTERVAL 90 MINUTES, INTERVAL 5 MINUTES)"))
    x = ups.where(F.coalesce(F.col("_next"), last) >= F.col("ts") + F.expr(f"INTERVAL {SILENT_S} SECONDS"))
    x = x.select("provider", "device", "ts", "back_at", stop.alias("_stop"), first.alias("_hour")).select("*", ticks.alias("tick"))
    big = (F.minute("tick") % 10 == 0) & (F.col("tick") >= F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    small = (F.minute("tick") % 15 == 0) & (F.col("tick") >= F.col("ts") + F.expr("INTERVAL 15 MINUTES"))
    return x.where(F.col("tick") <= F.col("_stop")).select("provider", "tick", "device", big.alias("big"), small.alias("small"), F.col("ts").alias("last_up_at"), "back_at").where("big OR small")


def heard(runs: DataFrame, within_s: int, inclusive: bool, keys: list[str]) -> DataFrame:
    """(keys, tick, n): devices with a success in the `within_s` seconds up to each tick, from the first such tick on.

    A device's successes less than that apart are one stretch; where stretches begin and end is summed by tick, so what the
    running sum goes over has a row a tick at most, however many devices there are.
    """
    by = Window.partitionBy("device").orderBy("ts")
    reach, edge = within_s * 1_000_000, int(inclusive)
    ups = runs.where("up").withColumns({"_s": _us("ts"), "_p": F.lag(_us("ts")).over(by), "_n": F.lead(_us("ts")).over(by)})
    starts = ups.where(F.col("_p").isNull() | (F.col("_s") >= F.col("_p") + reach + edge)).select(*keys, next_tick(F.col("_s")).alias("t"), F.lit(1).alias("d"))
    ends = ups.where(F.col("_n").isNull() | (F.col("_n") >= F.col("_s") + reach + edge)).select(*keys, next_tick(F.col("_s") + reach + edge).alias("t"), F.lit(-1).alias("d"))
    steps = starts.unionByName(ends).groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("t")
    x = steps.withColumn("n", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    step = TICK_S * 1_000_000
    x = x.withColumn("_until", F.greatest(F.col("t"), F.coalesce(F.lead("t").over(order) - step, F.col("t"))))
    return x.withColumn("t", F.explode(F.sequence("t", "_until", F.lit(step)))).select(*keys, _at(F.col("t")).alias("tick"), "n")


def with_base(quiet: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds base: devices of the provider with a success in the 24 h up to the tick."""
    base = heard(runs, BASE_H * 3600, True, ["provider"]).withColumnRenamed("n", "base")
    return quiet.join(base, ["provider", "tick"], "left")


def paused_ticks(runs: DataFrame, percent: int = 30) -> DataFrame:
    """(tick, failing, population, paused): ticks at which more than `percent` of the fleet fails, so that no outage may open.

    The fleet is every device with a success in 24 h, of any provider; one fails from 10 minutes without a success on.
    """
    every = heard(runs, BASE_H * 3600, True, []).withColumnRenamed("n", "population")
    well = heard(runs, SILENT_S, False, []).withColumnRenamed("n", "well")
    x = every.join(well, "tick", "left").where("population > 0")
    failing = F.col("population") - F.coalesce("well", F.lit(0))
    return x.select("tick", failing.alias("failing"), "population", (failing * 100 > F.col("population") * percent).alias("paused"))


def stretches(quiet: DataFrame) -> DataFrame:
    """`quiet` at the ticks where an outage may open, with the stretch of their provider.

    A tick may open one if the rules hold for all its silent devices, busy or not. An outage from it is closed once all of
    these are back, or at the age cap; ticks of a provider between which nothing can be open are stretches of their own.
    """
    n, cap = F.count_if("small"), CAP_MIN * 60_000_000
    last = F.max(F.coalesce(next_tick(_us("back_at")), F.lit(1 << 62))).alias("_last")
    t = quiet.groupBy("provider", "tick").agg(F.count_if("big").alias("_b"), n.alias("_n"), F.max("base").alias("_base"), last)
    t = t.where(may_open(F.col("_b"), F.col("_n"), F.col("_base")))
    t = t.withColumn("_s", _us("tick")).withColumn("_e", F.least(F.col("_last"), F.col("_s") + cap))
    order = Window.partitionBy("provider").orderBy("_s")
    fresh = F.coalesce(F.col("_s") > F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    t = t.withColumn("_f", fresh.cast("int")).withColumn("stretch", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return quiet.join(t.select("provider", "tick", "stretch"), ["provider", "tick"])


def may_open(big: Column, small: Column, base: Column) -> Column:
    """Whether counts open an outage. A base that is unknown or 0 switches the share off."""
    share = F.coalesce((base > 0) & (small >= FLOOR) & (4 * small >= base), F.lit(False))
    return (big >= BIG) | (small >= SMALL) | share


MEMBERS = "provider long, opened timestamp_ntz, kind string, size long, base long, device long, first_fail_at timestamp_ntz, recovered_at timestamp_ntz, closed_at timestamp_ntz, close_reason string"


def members(quiet: DataFrame, end: str, cap_min: int = CAP_MIN, paused: DataFrame | None = None) -> DataFrame:
    """MEMBERS of every outage up to `end`: at most one a tick and provider, the large check first, members fixed when it opens.

    A device in an open outage counts for no other. An outage closes at the first tick, 5 minutes apart, at which nine tenths
    of its members have recovered, or at its age cap; closing comes before opening. What is open at `end` has no closed_at.
    Rows stream through a task in order of stretch and tick: it holds a tick's silent devices and those that are in an open
    outage. At ticks that are `paused` (tick, paused) nothing opens.
    """
    if paused is not None:
        quiet = quiet.join(paused.where("paused").select("tick"), "tick", "left_anti")
    order = ["provider", "stretch", "tick", "device"]
    rows = stretches(quiet).select("provider", "stretch", "tick", "device", "big", "small", "base", "last_up_at", "back_at")
    rows = rows.repartition("provider", "stretch").sortWithinPartitions(*order)
    last = pd.Timestamp(end)
    step = pd.Timedelta(seconds=TICK_S)

    def evaluate(rows: pd.DataFrame, busy: dict) -> pd.DataFrame | None:
        tick = rows["tick"].iloc[0]
        for d in [d for d, until in busy.items() if until <= tick]:
            del busy[d]
        free = rows[[d not in busy for d in rows["device"]]]
        base = rows["base"].iloc[0]
        for kind in ("big", "small"):
            some = free[free[kind]]
            n = len(some)
            share = not pd.isna(base) and base > 0 and n >= FLOOR and 4 * n >= base
            if n >= BIG if kind == "big" else (n >= SMALL or share):
                need = -(-9 * n // 10)
                back = some["back_at"].dropna().sort_values()
                limit = tick + pd.Timedelta(minutes=cap_min)
                closed, why = limit, "AGE_CAP"
                if len(back) >= need and (at := back.iloc[need - 1].ceil(step)) <= limit:
                    closed, why = at, "RECOVERED"
                busy.update(dict.fromkeys(some["device"], closed))
                out = pd.DataFrame({"provider": some["provider"], "opened": tick, "kind": kind, "size": n, "base": base, "device": some["device"], "first_fail_at": some["last_up_at"] + step})
                out["recovered_at"] = some["back_at"].where(some["back_at"] <= min(closed, last))
                out["closed_at"], out["close_reason"] = (closed, why) if closed <= last else (pd.NaT, None)
                return out
        return None

    def fold(batches):
        held, key, busy = [], None, {}

        def done():
            nonlocal busy
            if held:
                yield from (x for x in [evaluate(pd.concat(held), busy)] if x is not None)
                held.clear()

        for pdf in batches:
            for k, part in pdf.groupby(["provider", "stretch", "tick"], sort=True):
                if k != key:
                    yield from done()
                    if key is None or k[:2] != key[:2]:
                        busy = {}
                    key = k
                held.append(part)
        yield from done()

    return rows.mapInPandas(fold, MEMBERS)


def outages(of: DataFrame) -> DataFrame:
    """(provider, opened, kind, tier, size, base, first_fail_at, status, closed_at, close_reason): a row an outage, from its members."""
    same = [F.max(c).alias(c) for c in ("kind", "size", "base", "closed_at", "close_reason")]
    x = of.groupBy("provider", "opened").agg(*same, F.min("first_fail_at").alias("first_fail_at"))
    names = ("LARGE", "MEDIUM", "SMALL", "MICRO")
    tier = F.lit(None)
    for least, name in reversed(list(zip(TIERS, names, strict=True))):
        tier = F.when(F.col("size") >= least, name).otherwise(tier)
    status = F.when(F.col("closed_at").isNull(), "OPEN").otherwise("CLOSED")
    return x.select("provider", "opened", "kind", tier.alias("tier"), "size", "base", "first_fail_at", status.alias("status"), "closed_at", "close_reason")


def receipts(providers: DataFrame, ticks: DataFrame, found: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(provider, tick, result): a receipt for each provider and tick that has none yet, also where nothing opened.

    ticks (tick, evaluated_at): a tick that is more than 5 minutes late is STALE, and what it would have opened isn't taken.
    """
    late = _us("evaluated_at") - _us("tick") > STALE_S * 1_000_000
    x = providers.select("provider").distinct().crossJoin(F.broadcast(ticks.select("tick", late.alias("_late"))))  # ticks of one evaluation
    if ledger is not None:
        x = x.join(ledger.select("provider", "tick"), ["provider", "tick"], "left_anti")
    hit = found.select("provider", F.col("opened").alias("tick"), F.lit(True).alias("_hit"))
    result = F.when(F.col("_late"), "STALE").when(F.col("_hit"), "OPENED").otherwise("NOTHING")
    return x.join(hit, ["provider", "tick"], "left").select("provider", "tick", result.alias("result"))


def keep_new(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of (provider, opened) that the ledger of ticks has not, so that a batch that is run again adds nothing."""
    done = ledger.select("provider", F.col("tick").alias("opened"))
    return found.join(done, ["provider", "opened"], "left_anti")


def evaluate_tick(runs: DataFrame, open_members: DataFrame, tick: dt.datetime, base: bool = True) -> DataFrame:
    """(provider, opened, kind, size, base, device, first_fail_at) of what opens at one tick, given who is in an open outage.

    Counts are sums over partial aggregates and devices are told apart by joins, so no provider is gathered anywhere.
    """
    now = F.lit(tick).cast("timestamp_ntz")
    up = runs.where(F.col("up") & (F.col("ts") <= now)).groupBy("device").agg(F.max(F.struct("ts", "provider")).alias("x")).select("device", "x.provider", F.col("x.ts").alias("last"))
    age = _us(now) - _us("last")
    up = up.withColumn("_age", age)
    free = up.where(F.col("_age").between(SILENT_S * 1_000_000, 1_800_000_000)).join(open_members.select("device"), "device", "left_anti")
    small = F.col("_age") >= RECOVERED_S * 1_000_000
    is_big, is_small = tick.minute % 10 == 0, tick.minute % 15 == 0
    live = up.where(F.col("_age") <= BASE_H * 3_600_000_000).groupBy("provider").agg(F.count("*").alias("base"))
    counts = free.groupBy("provider").agg(F.count("*").alias("b"), F.count_if(small).alias("s")).join(live, "provider", "left")
    if not base:
        counts = counts.withColumn("base", F.lit(None).cast("long"))
    none = F.lit(0)
    fires = counts.withColumns({"_big": (F.col("b") >= BIG) & F.lit(is_big), "_small": may_open(none, F.col("s"), F.col("base")) & F.lit(is_small)}).where("_big OR _small")
    x = free.join(fires, "provider").where(F.col("_big") | small)
    kind = F.when(F.col("_big"), "big").otherwise("small")
    size = F.when(F.col("_big"), F.col("b")).otherwise(F.col("s"))
    return x.select("provider", now.alias("opened"), kind.alias("kind"), size.alias("size"), "base", "device", (F.col("last") + F.expr("INTERVAL 5 MINUTES")).alias("first_fail_at"))
