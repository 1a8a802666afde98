"""Paired bootstrap by clusters: average precision and Brier score of two models in many replicates at once.

A replicate gives each cluster a Poisson weight, drawn from a hash of the cluster and the replicate's number, so it depends on
neither partitions nor order. Rows are never multiplied by replicates: tasks hold a range of scores, highest first, and work on
vectors with one entry a replicate. Where a range begins, the sums of the ranges before are known from a pass that adds them up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Rows whose weights a task holds at once.
ROWS = 2048
_P = 2_147_483_647
#: Chances that a Poisson variable of mean 1 is at most k.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def weights(cluster: np.ndarray, replicates: int, first: int = 0) -> np.ndarray:
    """A row a cluster, a column a replicate: whole numbers of mean 1. Replicate 0 is the sample itself, with weights of 1."""
    r = np.arange(first, first + replicates, dtype=np.int64)
    x = ((cluster[:, None] % _P) * 48_271 + r * 1_103_515_245 % _P + 12_345) % _P
    x = x * x % _P * x % _P
    x = (x + x * 69_621 % _P + r * 40_692) % _P
    x = x * x % _P * x % _P
    out = np.searchsorted(_POISSON, x / _P, side="right")
    out[:, r == 0] = 1
    return out.astype(np.float64)


def _ranged(df: DataFrame, cluster: str, label: str, score: str) -> DataFrame:
    """Rows by ranges of the score, highest first; equal scores share a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(cluster).cast("long").alias("c"), F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s")).dropna()
    return cut(rows.repartitionByRange(n, F.desc("s")).withColumn("bin", F.spark_partition_id()))


def average_precision(df: DataFrame, cluster: str, label: str, score: str, replicates: int) -> DataFrame:
    """(replicate, ap): weighted step-wise average precision. A replicate without a positive has none."""
    spark = df.sparkSession
    ranged = _ranged(df, cluster, label, score)

    def totals(batches):
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                bins, at = np.unique(part["bin"].to_numpy(), return_inverse=True)
                w, y = weights(part["c"].to_numpy(), replicates), part["y"].to_numpy()
                for j, name in enumerate(bins.tolist()):
                    own = at == j
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, name), pa.int32()), pa.array(np.arange(replicates)), pa.array(y[own] @ w[own]), pa.array(w[own].sum(axis=0))], ["bin", "replicate", "hits", "n"])

    # A row a range and replicate, whatever the number of rows.
    sums = ranged.mapInArrow(totals, "bin int, replicate long, hits double, n double").groupBy("bin", "replicate").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toPandas()
    bins = sorted(set(sums["bin"]))
    hits, n = (sums.pivot(index="bin", columns="replicate", values=c).reindex(bins).to_numpy() if bins else np.zeros((0, replicates)) for c in ("hits", "n"))
    begin = spark.sparkContext.broadcast({b: (np.cumsum(hits, axis=0)[i] - hits[i], np.cumsum(n, axis=0)[i] - n[i]) for i, b in enumerate(bins)})
    positives = hits.sum(axis=0) if bins else np.zeros(replicates)

    def steps(batches):
        ap, state, open_ = np.zeros(replicates), None, None
        tp = fp_tp = None

        def close():
            """Ends the group of equal scores."""
            nonlocal tp, fp_tp, ap
            if open_ is not None:
                tp, fp_tp = tp + open_[1], fp_tp + open_[2]
                ap = ap + np.where(fp_tp > 0, open_[1] * tp / np.maximum(fp_tp, 1), 0)

        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                s, y, name = part["s"].to_numpy(), part["y"].to_numpy(), part["bin"].to_numpy()
                w = weights(part["c"].to_numpy(), replicates)
                cuts = np.concatenate([[0], np.flatnonzero((s[1:] != s[:-1]) | (name[1:] != name[:-1])) + 1])
                h, m = np.add.reduceat(w * y[:, None], cuts), np.add.reduceat(w, cuts)
                for j, i in enumerate(cuts.tolist()):
                    if open_ is not None and (name[i], s[i]) == open_[0]:
                        open_ = (open_[0], open_[1] + h[j], open_[2] + m[j])
                        continue
                    close()
                    if name[i] != state:
                        state = name[i]
                        tp, fp_tp = begin.value[int(state)]
                    open_ = ((name[i], s[i]), h[j], m[j])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(ap)], ["replicate", "part"])

    order = ranged.repartition(max(1, len(bins)), "bin").sortWithinPartitions("bin", F.desc("s"))
    parts = order.mapInArrow(steps, "replicate long, part double").groupBy("replicate").agg(F.sum("part").alias("part"))
    of = spark.createDataFrame([(i, float(p)) for i, p in enumerate(positives)], "replicate long, p double")
    return parts.join(F.broadcast(of), "replicate").select("replicate", F.when(F.col("p") > 0, F.col("part") / F.col("p")).alias("ap"))


def brier(df: DataFrame, cluster: str, label: str, score: str, replicates: int) -> DataFrame:
    """(replicate, brier): weighted mean of the squared distance of score and label, from sums by cluster."""
    rows = df.select(F.col(cluster).cast("long").alias("c"), F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s")).dropna()
    by = rows.groupBy("c").agg(F.sum((F.col("s") - F.col("y")) ** 2).alias("e"), F.count("*").cast("double").alias("n"))

    def total(batches):
        e, n = np.zeros(replicates), np.zeros(replicates)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                w = weights(part["c"].to_numpy(), replicates)
                e, n = e + part["e"].to_numpy() @ w, n + part["n"].to_numpy() @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(e), pa.array(n)], ["replicate", "e", "n"])

    x = by.mapInArrow(total, "replicate long, e double, n double").groupBy("replicate").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    return x.select("replicate", F.when(F.col("n") > 0, F.col("e") / F.col("n")).alias("brier"))


def paired(df: DataFrame, cluster: str, label: str, before: str, after: str, replicates: int = 1000) -> DataFrame:
    """(replicate, d_ap, d_brier): what `after` gains over `before`; replicate 0 is the sample. Clusters are whole numbers: devices, or days."""
    ap = [average_precision(df, cluster, label, s, replicates + 1).withColumnRenamed("ap", f"ap{i}") for i, s in enumerate((before, after))]
    br = [brier(df, cluster, label, s, replicates + 1).withColumnRenamed("brier", f"b{i}") for i, s in enumerate((before, after))]
    x = ap[0].join(ap[1], "replicate").join(br[0], "replicate").join(br[1], "replicate")
    return x.select("replicate", (F.col("ap1") - F.col("ap0")).alias("d_ap"), (F.col("b1") - F.col("b0")).alias("d_brier"))


def interval(deltas: DataFrame, level: float = 0.95) -> DataFrame:
    """(metric, estimate, low, high): the sample's delta and percentiles of those of the replicates, of which there are few."""
    out = None
    for name in ("d_ap", "d_brier"):
        tail = (1 - level) / 2
        own = F.when(F.col("replicate") > 0, F.col(name))
        x = deltas.agg(F.lit(name).alias("metric"), F.max(F.when(F.col("replicate") == 0, F.col(name))).alias("estimate"), F.percentile(own, tail).alias("low"), F.percentile(own, 1 - tail).alias("high"))
        out = x if out is None else out.unionByName(x)
    return out
