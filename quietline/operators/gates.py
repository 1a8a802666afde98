"""Gates that a study passes before it reports: features, classes, mappings, sources, and stability over time. They fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import running

#: The least a feature must show in training.
COVERAGE, OBSERVATIONS, DEVICES, VARYING, TRANSITIONS = 0.25, 3, 100, 0.10, 5


def features(df: DataFrame, names: list[str], device: str, at: str, reboots: tuple[str, str], boot_age: str | None = None, devices: int = DEVICES) -> DataFrame:
    """(feature, coverage, with_three, iqr, varying_share, transition_share, transitions, eligible), one row a feature.

    Two aggregates: by device and feature, then by feature. A feature passes with enough rows, devices that were seen on three
    times, a spread, and devices in which it varies; that of the boot age with devices and times of a reboot instead.
    """
    once, day = reboots
    long_ = df.select(device, at, once, day, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in names))).alias("f"))
    seen = long_.select(device, at, once, day, "f.feature", "f.v").where("v IS NOT NULL")
    each = seen.groupBy("feature", device).agg(F.count_distinct(at).alias("times"), (F.max("v") - F.min("v")).alias("range"), F.max(day).alias("boots"), F.sum(once).alias("once"), F.count("*").alias("rows"))
    share = lambda c: F.count_if(c) / F.count("*")
    by = each.groupBy("feature").agg(F.sum("rows").alias("rows"), F.count_if(F.col("times") >= OBSERVATIONS).alias("with_three"), share(F.col("range") > 0).alias("varying_share"), share(F.col("boots") > 0).alias("transition_share"), F.sum("once").cast("long").alias("transitions"))
    iqr = seen.groupBy("feature").agg((F.percentile("v", 0.75) - F.percentile("v", 0.25)).alias("iqr"))
    every = df.agg(F.count("*").alias("n"))
    x = by.join(iqr, "feature").crossJoin(F.broadcast(every)).withColumn("coverage", F.col("rows") / F.col("n"))
    varies = F.col("varying_share") >= VARYING
    if boot_age:
        boots = (F.col("transition_share") >= VARYING) & (F.col("transitions") >= TRANSITIONS)
        varies = F.when(F.col("feature") == boot_age, boots).otherwise(varies)
    ok = (F.col("coverage") >= COVERAGE) & (F.col("with_three") >= devices) & (F.col("iqr") > 0) & varies
    return x.select("feature", "coverage", "with_three", "iqr", "varying_share", "transition_share", "transitions", ok.alias("eligible"))


def classes(df: DataFrame, split: str, device: str, observed: Column, outcomes: list[str], least: int, held: tuple[str, ...]) -> DataFrame:
    """(split, n, devices, observed_devices, <outcome>_positive, <outcome>_control, passed): devices of each class in each split."""
    n = [F.count_distinct(F.when(F.col(o) == y, F.col(device))).alias(f"{o}_{name}") for o in outcomes for y, name in ((1, "positive"), (0, "control"))]
    x = df.groupBy(split).agg(F.count("*").alias("n"), F.count_distinct(device).alias("devices"), F.count_distinct(F.when(observed, F.col(device))).alias("observed_devices"), *n)
    sides = [F.col(f"{o}_{name}") for o in outcomes for name in ("positive", "control")]
    both = F.least(*sides) > 0
    enough = (F.least("observed_devices", *sides) >= least) | ~F.col(split).isin(*held)
    return x.withColumn("passed", both & enough)


def mapping(df: DataFrame, device: str, mapped: str, account: str, least: float = 0.9) -> DataFrame:
    """(total, mapped, coverage, passed, reason): enough devices are mapped, and each to an id and account of its own."""
    n = lambda c: F.count_distinct(F.when(F.col(mapped).isNotNull(), F.col(c)))
    x = df.agg(F.count("*").alias("total"), F.count(mapped).alias("mapped"), n(device).alias("_d"), n(mapped).alias("_m"), n(account).alias("_a"))
    coverage = F.when(F.col("total") > 0, F.col("mapped") / F.col("total")).otherwise(0.0)
    single = (F.col("mapped") == F.col("_d")) & (F.col("mapped") == F.col("_m")) & (F.col("mapped") == F.col("_a"))
    reason = F.when(F.col("total") == 0, "NO_DEVICES").when(coverage < least, "COVERAGE").when(~single, "NOT_ONE_TO_ONE").otherwise("OK")
    return x.select("total", "mapped", coverage.alias("coverage"), (reason == "OK").alias("passed"), reason.alias("reason"))


def stability(early: DataFrame, late: DataFrame, cell: str) -> DataFrame:
    """(cells, early_rate, late_rate, spearman, lift, concentration, passed) from (cell, eligible, affected) of two periods.

    Cells that both periods have: do their rates rank alike, and do the tenth with the highest early rates have more than their
    share of what the late period brings? Ranks come from ranges, so cells may be many.
    """
    e = early.where("eligible > 0").select(cell, F.col("eligible").alias("n1"), F.col("affected").alias("a1"))
    x = e.join(late.where("eligible > 0").select(cell, F.col("eligible").alias("n2"), F.col("affected").alias("a2")), cell)
    x = x.withColumns({"r1": F.col("a1") / F.col("n1"), "r2": F.col("a2") / F.col("n2")})
    rho = ranks(x, cell).agg(F.corr("k1", "k2").alias("spearman"))
    order = [F.desc("r1"), F.desc("n1"), F.col(cell)]
    top = running(x, order, {"k": F.lit(1)}).crossJoin(F.broadcast(x.agg(F.count("*").alias("cells"))))
    top = top.withColumn("chosen", F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("cells") / 10)))
    some = lambda c: F.sum(F.when(F.col("chosen"), F.col(c)))
    total = lambda c: F.sum(c)
    m = top.agg(
        F.max("cells").alias("cells"), (total("a1") / total("n1")).alias("early_rate"), (total("a2") / total("n2")).alias("late_rate"),
        ((some("a2") / some("n2")) / F.nullif(total("a2") / total("n2"), F.lit(0.0))).alias("lift"), (some("a2") / F.nullif(total("a2"), F.lit(0))).alias("concentration"),
    )
    ok = (F.col("cells") >= 20) & (F.col("spearman") >= 0.5) & (F.col("lift") >= 1.5)
    return m.crossJoin(rho).withColumn("passed", F.coalesce(ok, F.lit(False)))


def ranks(x: DataFrame, cell: str) -> DataFrame:
    """(cell, k1, k2): ranks of two rates over all cells, ties shared, from counts of equal rates before."""
    out = x.select(cell, "r1", "r2")
    for k, r in (("k1", "r1"), ("k2", "r2")):
        n = running(x.groupBy(r).agg(F.count("*").alias("c")), [F.col(r)], {"upto": F.col("c")})
        out = out.join(n.select(r, (2 * F.col("upto") - F.col("c") + 1).alias(k)), r)
    return out.select(cell, "k1", "k2")
