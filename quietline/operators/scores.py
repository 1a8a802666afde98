"""Model measures as aggregates and windows over distinct scores; and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Adds running sums, named, of columns over all rows in an order (within `by`, if given), the row itself included.

    Rows are split by ranges of the order, summed in each range, and get the totals of the ranges before; so no task holds
    more than a range. Rows that are equal in the order are told apart by nothing: give a whole order.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    ranged = cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_bin", F.spark_partition_id()))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_bin").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))  # a row a partition
    totals = totals.select("_bin", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    w = Window.partitionBy("_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = ranged.withColumns({name: F.sum(c).over(w) for name, c in sums.items()}).join(F.broadcast(totals), "_bin")
    return x.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_bin", *(f"_{name}" for name in sums))


def by_score(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, score, tp, fp, positives): counts at or above each distinct score, of which there are fewer than rows."""
    by = by or []
    g = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count("*").alias("c"))
    x = running(g, [F.desc(score)], {"tp": F.col("hits"), "_n": F.col("c")}, by)
    total = df.groupBy(*by).agg(F.sum(F.col(label).cast("long")).alias("positives"))
    x = x.join(total, by) if by else x.crossJoin(F.broadcast(total))  # one row
    return x.select(*by, score, "tp", (F.col("_n") - F.col("tp")).alias("fp"), "positives", "hits")


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Step-wise sum of precision times the gain in recall (not the interpolated area)."""
    x = by_score(df, score, label, by)
    step = F.col("hits") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return x.where("positives > 0").groupBy(*(by or [])).agg(F.sum(step).alias("ap"))


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold with the best F1, ties to the higher one."""
    x = by_score(df, score, label).withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives")))
    return x.orderBy(F.desc("f1"), F.desc(score)).limit(1).select(F.col(score).alias("threshold"), "f1")


def calibration(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, positives, mean_p): the last bin is closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(p).alias("mean_p"))


def rank_ties(value: Column | str, *by: str) -> Column:
    """Ranks with the mean for ties, doubled so that they are whole."""
    w = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return 2 * F.rank().over(w) + F.count("*").over(same) - 1


def adjusted(df: DataFrame, p: str, bins: int = 4096) -> DataFrame:
    """Adds q: p-values after Benjamini and Hochberg; nulls are left out of the count.

    Equal p-values share the last of their ranks, which the minimum takes anyway. Values lie in [0, 1], so bins of equal width
    order them: ranks come from the counts of the bins before, minima from those of the bins after.
    """
    live = df.where(F.col(p).isNotNull()).withColumn("_bin", F.floor(F.col(p) * bins))
    up, down = Window.orderBy("_bin"), Window.orderBy(F.desc("_bin"))
    counts = live.groupBy("_bin").agg(F.count("*").alias("_c"))  # at most bins + 1 rows
    counts = counts.select("_bin", (F.sum("_c").over(up) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    each = live.groupBy("_bin", p).agg(F.count("*").alias("_k"))
    own = Window.partitionBy("_bin").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    each = each.join(F.broadcast(counts), "_bin")
    each = each.withColumn("_q", F.col(p) * F.col("_n") / (F.col("_before") + F.sum("_k").over(own)))
    later = each.groupBy("_bin").agg(F.min("_q").alias("_least"))
    later = later.select("_bin", F.min("_least").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    back = Window.partitionBy("_bin").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = each.join(F.broadcast(later), "_bin").select(p, F.least(F.lit(1.0), F.min("_q").over(back), "_later").alias("q"))
    return live.drop("_bin").join(q, p)


def brier(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """(brier, gap, ece): mean squared error, mean probability less prevalence, and the bins' distances weighted by their rows."""
    b = calibration(df, p, label, bins)
    squared = df.agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"), (F.avg(p) - F.avg(label)).alias("gap"))
    ece = b.agg((F.sum(F.abs(F.col("positives") - F.col("mean_p") * F.col("n"))) / F.sum("n")).alias("ece"))
    return squared.crossJoin(ece)  # one row each


def thresholds(df: DataFrame, score: str, label: str, recall: float = 0.8, budget: float = 0.1) -> DataFrame:
    """(rule, threshold): best F1; the highest score that reaches a recall; and the lowest that at most a budget of rows exceeds.

    The last is the quantile 1 - budget, that of the next higher row where it falls between two.
    """
    x = by_score(df, score, label)
    f1 = best_f1(df, score, label).select(F.lit("best_f1").alias("rule"), F.col("threshold").cast("double"))
    reached = x.where(F.col("tp") >= F.lit(recall) * F.col("positives")).agg(F.max(score).cast("double").alias("threshold"))
    n = F.col("_n")
    rows = x.select(score, (F.col("tp") + F.col("fp")).alias("_above")).crossJoin(df.agg(F.count("*").alias("_n")))
    # In descending order the row has this rank, from 1; scores are distinct here, so the first that reaches it.
    rank = n - F.ceil((n - 1) * F.lit(1 - budget))
    at = rows.where(F.col("_above") >= rank).agg(F.max(score).cast("double").alias("threshold"))
    named = lambda d, name: d.select(F.lit(name).alias("rule"), "threshold")
    return f1.unionByName(named(reached, "recall")).unionByName(named(at, "budget"))


def equal_devices(df: DataFrame, device: str, label: str, candidate: str, baseline: str) -> DataFrame:
    """(eligible, mean_delta, median_delta, improved): average precision of two scores within each device that has both outcomes."""
    both = df.groupBy(device).agg(F.count_distinct(label).alias("_k")).where("_k = 2").select(device)
    rows = df.join(both, device, "left_semi")
    one = lambda s, name: average_precision(rows, s, label, [device]).select(device, F.col("ap").alias(name))
    x = one(candidate, "a").join(one(baseline, "b"), device).select((F.col("a") - F.col("b")).alias("d"))
    return x.agg(F.count("*").alias("eligible"), F.avg("d").alias("mean_delta"), F.median("d").alias("median_delta"), F.avg((F.col("d") > 0).cast("int")).alias("improved"))


def coefficients(model, features: list[str], name: str):
    """[(model, feature, standardized coefficient)] of a fitted logistic pipeline."""
    return [(name, f, float(c)) for f, c in zip(features, model.stages[-1].coefficients, strict=True)]


def logistic(features: list[str], label: str, rows: int, c: float = 1.0):
    """Median imputation, scaling and L2 logistic regression; the strength is per row, hence 1 / (c * rows)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{f}_filled" for f in features]
    return Pipeline(stages=[Imputer(strategy="median", relativeError=1e-6, inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol=label, regParam=1 / (c * max(1, rows)), maxIter=50)])


def forest(features: list[str], label: str, trees: int = 300):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"{f}_filled" for f in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), RandomForestClassifier(featuresCol="raw", labelCol=label, numTrees=trees, maxDepth=8, minInstancesPerNode=100, featureSubsetStrategy="sqrt", seed=7)])


def bootstrap(df: DataFrame, cluster: str, value: str, replicates: int = 200) -> DataFrame:
    """(lo, hi): percentile interval of the mean under resampling of clusters. Weights are Poisson draws from hashes of (cluster, replicate), so they don't depend on partitions."""
    per = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.pmod(F.xxhash64(F.lit(3), cluster, "b"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    w = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    means = per.groupBy("b").agg((F.sum(w * F.col("s")) / F.nullif(F.sum(w * F.col("c")), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
