"""Connected components of an undirected graph by contraction in the tasks, then hooking and shortcuts as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Edges that a task contracts at once.
LOT = 500_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of some edges but the roots: root is the smallest node that these edges reach."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, root[side], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect what a task's edges connect, each from a node to the smallest one that it reaches there."""

    def contract(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
            n += batch.num_rows
            if n >= LOT:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    def emit(held):
        node, root = _roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    return edges.mapInArrow(contract, "a long, b long")


def components(edges: DataFrame, store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, root) from (a, b): root is the smallest node that a node can reach. Nodes without edges aren't there.

    Tasks first contract their own edges, and then what is left in lots of LOT edges. What ends in a single lot is done. Else
    rounds follow that send every node's smallest neighbour along its edges ("star" steps): first larger neighbours are
    hooked to the smallest one, then smaller ones. Stars of any size are sums over partial aggregates; a hot node's join side
    can be split. Each round is contracted like the input. Rounds end when no edge changes; paths shorten by a factor each
    time, so their number is logarithmic. `store` computes a frame and cuts its lineage.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def contracted(e):
        """(edges, whether they are the components)."""
        own = store(_contracted(e))
        lots = -(-own.count() // LOT)
        then = store(_contracted(own.repartition(max(1, lots))))
        return (then if lots < 2 else store(then.distinct())), lots < 2

    now, done = contracted(edges.where("a != b").select(F.col("a").cast("long"), F.col("b").cast("long")))
    size = None if done else _print(now)
    while not done:
        # Large star: of every node, hook the larger neighbours to the smallest of the node and its neighbours.
        sided = both(now)
        least = sided.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sided.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: of every node, hook its smaller neighbours, and itself, to the smallest one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = large.join(low, "a").select(hooked.alias("e")).select("e.a", "e.b").where("a != b")
        now, done = contracted(small)
        if not done:
            new = _print(now)
            done, size = new == size, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _print(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: two 64-bit sums over different hashes."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64(F.lit(7), "b", "a").cast("decimal(20,0)"))).first()
    return r[0], r[1], r[2]
