"""Case and control windows, near and far contrasts, freshness of parameters, rank and mean tests, address groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scores import rank_ties, running


def paired_windows(episodes: DataFrame, informs: DataFrame, key: str, start: str, stop: str, at: str, least: int = 3) -> DataFrame:
    """(key, start, n_case, n_control): each key's latest episode whose two windows touch no episode and have `least` informs each.

    The case window runs from 7 h to 1 h before the start, the control window lies 7 days earlier. Joins are by key.
    """
    e = episodes.select(key, F.col(start).alias("start"), F.col(stop).alias("stop")).distinct()
    before = lambda hours: F.col("start") - F.expr(f"INTERVAL {hours} HOURS")
    side = lambda name, h: F.struct(F.lit(name).alias("side"), before(7 + h).alias("lo"), before(1 + h).alias("hi"))
    w = e.select(key, "start", F.inline(F.array(side("case", 0), side("control", 168))))
    o = e.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    free = w.join(o, (w[key] == o["_key"]) & (o["_start"] < w["hi"]) & (o["_stop"] > w["lo"]), "left_anti")
    i = informs.select(F.col(key).alias("_key"), F.col(at).alias("_at"))
    seen = free.join(i, (free[key] == i["_key"]) & (i["_at"] >= free["lo"]) & (i["_at"] < free["hi"]))
    counts = seen.groupBy(key, "start").agg(F.count_if(F.col("side") == "case").alias("n_case"), F.count_if(F.col("side") == "control").alias("n_control"))
    best = F.max(F.struct("start", "n_case", "n_control")).alias("b")
    return counts.where((F.col("n_case") >= least) & (F.col("n_control") >= least)).groupBy(key).agg(best).select(key, "b.*")


def near_far(rows: DataFrame, key: list[str], onset: str, at: str, value: str, near_s: int = 21_600, least_near: int = 3, least_far: int = 9) -> DataFrame:
    """(key, n_near, n_far, sum_near, sum_far, supported): rows at most `near_s` seconds before the onset, that included, against those further back."""
    lead = F.unix_timestamp(onset) - F.unix_timestamp(at)
    near, far = lead.between(0, near_s), lead > near_s
    aggs = [F.count(F.when(c, F.col(value))).alias(f"n_{n}") for n, c in (("near", near), ("far", far))] + [F.sum(F.when(c, F.col(value))).alias(f"sum_{n}") for n, c in (("near", near), ("far", far))]
    return rows.groupBy(*key).agg(*aggs).withColumn("supported", (F.col("n_near") >= least_near) & (F.col("n_far") >= least_far))


def freshness(df: DataFrame, name: str, value: Column, stamp: Column, read_at: Column, hours: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(name, no_time, future, stale, invalid, fresh): counts of leaf values, each in the first of these states that fits."""
    age = F.unix_micros(read_at.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))
    bad = value.isNull() | F.isnan(value)
    bad = bad | (value < low) if low is not None else bad
    bad = bad | (value > high) if high is not None else bad
    state = F.when(age.isNull(), "no_time").when(age < 0, "future").when(age > hours * 3_600_000_000, "stale").when(bad, "invalid").otherwise("fresh")
    s = df.select(name, state.alias("state"))
    return s.groupBy(name).agg(*(F.count_if(F.col("state") == x).alias(x) for x in ("no_time", "future", "stale", "invalid", "fresh")))


def signed_ranks(df: DataFrame, by: str, diff: str) -> DataFrame:
    """(by, n, w_plus2, w_minus2, rank_biserial, z, p): Wilcoxon's test of non-zero differences; rank sums are doubled, so whole.

    z has the normal approximation's tie correction and is null if its variance is 0.
    """
    x = df.where(F.col(diff) != 0).select(by, F.abs(diff).alias("a"), (F.col(diff) > 0).alias("up"))
    x = x.select(by, "up", rank_ties("a", by).alias("r2"), F.count("*").over(Window.partitionBy(by, "a")).alias("t"))
    g = x.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("up"), F.col("r2")).otherwise(0)).alias("w_plus2"), F.sum(F.when(~F.col("up"), F.col("r2")).otherwise(0)).alias("w_minus2"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    g = g.withColumn("rank_biserial", (F.col("w_plus2") - F.col("w_minus2")) / (F.col("w_plus2") + F.col("w_minus2")))
    g = g.withColumn("z", F.when(spread > 0, (F.col("w_plus2") / 2 - n * (n + 1) / 4) / spread)).drop("ties")
    return _with_p(g, lambda r: math.erfc(abs(r["z"]) / math.sqrt(2)) if r["z"] is not None else None)


def student_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t, by Simpson's rule on the angle whose tangent is t / sqrt(df)."""
    x = np.linspace(0, math.atan(abs(t) / math.sqrt(df)), 4001)
    y = np.cos(x) ** (df - 1)
    area = (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return float(max(0.0, 1 - 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * area))


def t_tests(df: DataFrame, by: str, value: str, mean: float = 0.0) -> DataFrame:
    """(by, n, mean, t, p): the one-sample test; t and p are null for fewer than two values or no spread."""
    g = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    g = g.withColumn("t", F.when((F.col("n") > 1) & (F.col("sd") > 0), (F.col("mean") - mean) / F.col("sd") * F.sqrt("n"))).drop("sd")
    return _with_p(g, lambda r: student_p(r["t"], r["n"] - 1) if r["t"] is not None else None)


#: Coefficients of a published rational approximation of the normal quantile (relative error 1.2e-9).
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
#: Polynomials in 1 / sqrt(n), lowest power first, of the two outer weights of Shapiro and Wilk's test.
_LAST, _LAST_BUT_ONE = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)


def _poly(c, x: Column) -> Column:
    """A polynomial, highest power first."""
    out = F.lit(float(c[0]))
    for k in c[1:]:
        out = out * x + F.lit(float(k))
    return out


def normal_quantile(p: Column) -> Column:
    low = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(_C, low) / _poly(_D, low)
    q = p - 0.5
    return F.when(F.abs(q) <= 0.47575, q * _poly(_A, q * q) / _poly(_B, q * q)).when(q < 0, tail).otherwise(-tail)


def shapiro(df: DataFrame, by: str, value: str, ident: str) -> DataFrame:
    """(by, n, w, p): Shapiro and Wilk's test of normality by Royston's approximation, for groups of 3 rows or more that vary.

    Ranks come from ranges of (by, value), less the rows of the groups before, so no group is in one task. The weights are
    expected normal order statistics, of which the outer two on each side are replaced; so the statistic is made of sums over
    ranks and of the two smallest and largest values.
    """
    rows = df.select(by, F.col(value).cast("double").alias("x"), ident).dropna()
    rows = rows.where(~F.isnan("x"))
    ranked = running(rows, [F.col(by), F.col("x"), F.col(ident)], {"k": F.lit(1)})
    g = ranked.groupBy(by).agg(F.min("k").alias("_first"), F.count("*").alias("n"), F.avg("x").alias("mean"))
    i = F.col("k") - F.col("_first") + 1
    x = join_groups(ranked, g, by).withColumn("i", i).withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    end = lambda j: F.max(F.when(F.col("i") == j, F.col("x")))
    n = F.col("n")
    s = x.where("n >= 3").groupBy(by, "n").agg(
        F.sum(F.col("m") * F.col("x")).alias("mx"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum((F.col("x") - F.col("mean")) ** 2).alias("ss"),
        (end(n) - end(F.lit(1))).alias("outer"), (end(n - 1) - end(F.lit(2))).alias("inner"), F.max("m").alias("m1"), F.max(F.when(F.col("i") == n - 1, F.col("m"))).alias("m2"),
    ).where("ss > 0")
    u = 1 / F.sqrt(n)
    root = F.sqrt("mm")
    s = s.withColumn("a1", F.when(n == 3, math.sqrt(0.5)).otherwise(F.col("m1") / root + _poly((*reversed(_LAST), 0), u)))
    s = s.withColumn("a2", F.when(n > 5, F.col("m2") / root + _poly((*reversed(_LAST_BUT_ONE), 0), u)))
    few = (F.col("mm") - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("a1") ** 2)
    many = (F.col("mm") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * F.col("a1") ** 2 - 2 * F.col("a2") ** 2)
    middle = F.when(n > 5, (F.col("mx") - F.col("m1") * F.col("outer") - F.col("m2") * F.col("inner")) / F.sqrt(many) + F.col("a2") * F.col("inner"))
    middle = middle.when(n > 3, (F.col("mx") - F.col("m1") * F.col("outer")) / F.sqrt(few)).otherwise(0.0)
    s = s.withColumn("w", F.least(F.lit(1.0), (middle + F.col("a1") * F.col("outer")) ** 2 / F.col("ss")))

    def p(r):
        n, w = r["n"], r["w"]
        if n == 3:
            return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        if w >= 1:
            return 1.0
        y, k = math.log(1 - w), math.log(n)
        if n <= 11:
            gamma = -2.273 + 0.459 * n
            if y >= gamma:
                return 0.0
            y, mean, sd = -math.log(gamma - y), 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        else:
            mean, sd = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3, math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
        return 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))

    return _with_p(s.select(by, "n", "w"), p)


def join_groups(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Rows with the columns of their group; groups that hold more than a 4,096th of all rows are broadcast, so none is gathered."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    border = max(1, total // 4096)
    hot, rest = groups.where(F.col("n") > border), groups.where(F.col("n") <= border)
    return rows.join(F.broadcast(hot), by).unionByName(rows.join(rest, by))


def _with_p(g: DataFrame, p) -> DataFrame:
    """Adds p to rows that are one a group by now."""
    schema = T.StructType([*g.schema.fields, T.StructField("p", T.DoubleType())])

    def add(batches):
        for b in batches:
            import pyarrow as pa

            rows = b.to_pylist()
            yield b.append_column("p", pa.array([p(r) for r in rows], pa.float64()))

    return g.mapInArrow(add, schema)


def address_groups(entities: DataFrame, group: str, device: str) -> DataFrame:
    """(group, scope, part, context, n, confidence): the best address that a group's devices share.

    `entities` has kind, value and score a row. HOUSE joins a house to a road or locality and needs two devices; GALI joins a
    road to a locality and needs three. A house goes before a lane; then more devices, a larger sum of scores, and names decide.
    """
    e = entities.where("score >= 0.5").groupBy(group, device, "kind", "value").agg(F.max("score").alias("score"))
    is_local = F.col("kind").isin("locality", "sub_locality")
    left = e.where(F.col("kind").isin("house_details", "road")).select(group, device, F.when(F.col("kind") == "road", "GALI").otherwise("HOUSE").alias("scope"), F.col("value").alias("part"), F.col("score").alias("_s"))
    right = e.where(is_local | (F.col("kind") == "road")).select(group, device, is_local.alias("_local"), F.col("value").alias("context"), F.col("score").alias("_c"))
    pairs = left.join(right, [group, device]).where("scope = 'HOUSE' OR _local").groupBy(group, device, "scope", "part", "context").agg(((F.max("_s") + F.max("_c")) / 2).alias("s"))
    sums = pairs.groupBy(group, "scope", "part", "context").agg(F.count("*").alias("n"), F.sum("s").alias("total"))
    fit = sums.where("n >= CASE scope WHEN 'HOUSE' THEN 2 ELSE 3 END")
    best = Window.partitionBy(group).orderBy(F.desc("scope"), F.desc("n"), F.desc("total"), "part", "context")
    one = fit.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return one.select(group, "scope", "part", "context", "n", F.round(F.least(F.lit(0.9), F.col("total") / F.col("n")), 2).alias("confidence"))
