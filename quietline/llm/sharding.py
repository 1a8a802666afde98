"""Resharding by minimum-cost flow: documents move from old shards to new capacities so that the fewest bytes move.

A store is a table of rows with the shard that each lies in and a list of the files that hold them. Files of a shard are in
order of size class, large documents first, then of a hash, so each file is a block of its shard. A plan asks, from the sizes
of the old shards and the new capacities alone, which flow from shard to shard costs least (`cheapest_flow`; a byte that stays
costs nothing). The flow is turned into cuts in each shard's order: what stays comes first and the rest follows, block by block,
for each target in turn, so that a cut falls between small documents. A block that a cut goes through is split at a document.
What a plan leaves uneven, as documents can't be split, the next plan levels. The cuts are a bounded number, so each row's new
shard is an expression of its own columns. Only files with a row that leaves are written anew; rows that move go to new files
of their shards, and all other files stay as they are.
"""

from __future__ import annotations

import heapq
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import keep_until_clear, shared_dir, stored, tasks

#: A plan sums the sizes of 2^RANGE_BITS ranges of the hash within a shard and size class.
RANGE_BITS = 8
#: Plans that may follow each other; the last ones move next to nothing.
PLANS = 4

#: Sizes by law: bytes of the text plus 1, or 1 a row.
LAWS = {"bytes": "size", "rows": "one"}


def cheapest_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts by (from, to) that send each supply to the demands at least total cost; cost(i, j) is that of a unit, 0 or more.

    Successive shortest paths with potentials over the shards, whose number is a parameter; so it runs on the driver. The sums
    of supply and demand must be equal.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    flow: dict[tuple[int, int], int] = {}
    left, open_ = list(supply), list(demand)
    high_i, high_j = [0] * n, [0] * m
    while any(left):
        # Dijkstra from every supplier that has something left; edges go forward at their price and back along the flow.
        far = {("s", i): (0 if left[i] else float("inf")) for i in range(n)} | {("t", j): float("inf") for j in range(m)}
        before: dict = {}
        heap = [(0, ("s", i)) for i in range(n) if left[i]]
        while heap:
            d, at = heapq.heappop(heap)
            if d > far[at]:
                continue
            if at[0] == "s":
                steps = ((("t", j), price[at[1]][j] + high_i[at[1]] - high_j[j]) for j in range(m))
            else:
                steps = ((("s", i), -price[i][at[1]] + high_j[at[1]] - high_i[i]) for i in range(n) if flow.get((i, at[1])))
            for to, step in steps:
                if d + step < far[to]:
                    far[to], before[to] = d + step, at
                    heapq.heappush(heap, (d + step, to))
        end = min((j for j in range(m) if open_[j]), key=lambda j: (far["t", j] + high_j[j], j))
        path, at = [], ("t", end)
        while at in before:
            path.append((before[at], at))
            at = before[at]
        amount = min([left[at[1]], open_[end], *(flow[b[1], a[1]] for a, b in path if a[0] == "t")])
        for a, b in path:
            key, sign = ((a[1], b[1]), 1) if a[0] == "s" else ((b[1], a[1]), -1)
            flow[key] = flow.get(key, 0) + sign * amount
        left[at[1]] -= amount
        open_[end] -= amount
        reach = max(d for d in far.values() if d < float("inf"))
        for i in range(n):
            high_i[i] += min(far["s", i], reach)
        for j in range(m):
            high_j[j] += min(far["t", j], reach)
    return {k: v for k, v in sorted(flow.items()) if v}


def even(total: int, shards: int) -> list[int]:
    """Capacities that are at most one apart."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def laid_out(docs: DataFrame, shards: int, by: str = "source") -> DataFrame:
    """A store of documents in `shards` old shards by the value of a column, null included: the layout that resharding starts from.

    (doc, shard, size, one, class, hash): doc is the whole row, whatever its columns; size the UTF-8 bytes of its text (null:
    none) plus 1. Rows that are equal are told apart by where they are read.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    place = [F.pmod(F.xxhash64(F.col(by)), F.lit(shards)).cast("int").alias("shard"), size.alias("size"), F.lit(1).cast("long").alias("one")]
    place += [(-F.floor(F.log2(size))).cast("int").alias("class"), F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("hash")]
    x = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"), *place)
    path = keep_until_clear(shared_dir(spark))
    _write(x, path)
    return spark.read.schema(x.schema).parquet(path)


def _write(rows: DataFrame, path: str) -> None:
    order = ["shard", "class", "hash"]
    # The finer the files, the fewer rows that stay are written anew.
    rows.repartitionByRange(2 * tasks(rows.sparkSession), *order).sortWithinPartitions(*order).write.parquet(path)


def _lookup(shard: Column, cuts: list[tuple[int, int, int, int]]) -> Column:
    """The new shard of a row: that of the last cut of its shard at or before its class and hash. cuts: (shard, class, hash, new)."""
    by: dict[int, list] = {}
    for old, *cut in sorted(cuts):
        by.setdefault(old, []).append(cut)
    out = shard
    for old, own in by.items():
        new = F.lit(own[0][2])
        for c, h, to in own[1:]:
            new = F.when((F.col("class") > c) | ((F.col("class") == c) & (F.col("hash") >= F.lit(h).cast("long"))), to).otherwise(new)
        out = F.when(shard == old, new).otherwise(out)
    return out.cast("int")


def _cuts(rows: DataFrame, flow: dict[tuple[int, int], int], size: str) -> list[tuple[int, int, int, int]]:
    """Where each old shard is cut so that its parts have the sizes of the flow: what stays first, then by target."""
    spark = rows.sparkSession
    wanted, cuts = [], []
    lowest = (-(1 << 31), -(1 << 63))
    for old in sorted({i for i, _ in flow}):
        parts = sorted(((j != old, j, v) for (i, j), v in flow.items() if i == old))
        cuts.append((old, *lowest, parts[0][1]))
        at = 0
        for (_, _, v), (_, to, _) in zip(parts, parts[1:], strict=False):
            at += v
            wanted.append((old, at, to))
    if not wanted:
        return cuts
    block = F.shiftright("hash", 64 - RANGE_BITS).cast("int")
    # At most 2^RANGE_BITS rows a shard and size class, however many documents.
    blocks = rows.withColumn("block", block).groupBy("shard", "class", "block").agg(F.sum(size).alias("size"))
    before = Window.partitionBy("shard").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    goal = spark.createDataFrame(wanted, "shard int, at long, to int")
    split = stored(F.broadcast(goal).join(blocks, "shard").where("at > before AND at <= before + size").select("shard", "at", "to", "class", "block", "before"))
    # Only documents of blocks that a cut goes through, of which there are as many as cuts.
    inside = rows.withColumn("block", block).join(F.broadcast(split.select("shard", "class", "block", "before").distinct()), ["shard", "class", "block"])
    run = Window.partitionBy("shard", "class", "block").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.select("shard", "class", "block", "hash", (F.col("before") + F.coalesce(F.sum(size).over(run), F.lit(0))).alias("begin"), F.col(size).alias("size"))
    met = inside.join(F.broadcast(split.drop("before")), ["shard", "class", "block"])
    # A document lies before a cut if its middle does.
    after = met.where(2 * F.col("begin") + F.col("size") > 2 * F.col("at")).groupBy("shard", "at", "to").agg(F.min(F.struct("class", "hash")).alias("x"))
    ends = split.join(after, ["shard", "at", "to"], "left").select("shard", "to", "class", "block", "x")
    for r in ends.collect():  # a row a cut
        c, h = (r["x"]["class"], r["x"]["hash"]) if r["x"] else _next(r["class"], r["block"])
        cuts.append((r["shard"], c, h, r["to"]))
    return cuts


def _next(size_class: int, block: int) -> tuple[int, int]:
    """The place where the next range of the hash begins."""
    half = 1 << (RANGE_BITS - 1)
    return (size_class, (block + 1) << (64 - RANGE_BITS)) if block + 1 < half else (size_class + 1, -(1 << 63))


def plan(rows: DataFrame, shards: int, law: str = "bytes", cost=None) -> Column:
    """The new shard of each row of a store, as an expression of its shard, class and hash.

    `cost(i, j)` is the price of a byte that goes from shard i to shard j, by default 0 if it stays and 1 if not.
    """
    size, new, best = LAWS[law], F.col("shard"), None
    for k in range(PLANS):
        now = rows.select(new.alias("shard"), "class", "hash", size)
        sums = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.sum(size).alias("n")).collect()}  # a row a shard
        supply = [sums.get(i, 0) for i in range(max([shards - 1, *sums]) + 1)]
        demand = even(sum(supply), shards)
        over = sum(max(0, s - d) for s, d in zip(supply, demand + [0] * (len(supply) - shards), strict=True))
        if best and over >= best[0]:
            break
        best = over, new
        if not over or k == PLANS - 1:
            break
        cuts = _cuts(now, cheapest_flow(supply, demand, cost or (lambda i, j: int(i != j))), size)
        # The lookup of a later plan starts from the shards of the plan before, which the lambda reads once.
        new = F.transform(F.array(new), lambda s: _lookup(s, cuts))[0]  # noqa: B023  called at once
    return best[1]


def resharded(store: DataFrame, shards: int, law: str = "bytes", cost=None) -> DataFrame:
    """The store in `shards` shards, with `law`: files without a row that leaves stay, all others are written anew.

    Rows keep all their columns; null and empty texts count 1 byte, null and repeated ids and repeated rows are rows like any
    other. An empty store has no rows afterwards either. Shards are near equal in bytes, to less than a document, as long as
    no document alone is larger than a shard; by rows, their counts are at most one apart.
    """
    spark = store.sparkSession
    if law not in LAWS:
        raise ValueError(f"no law {law}")
    new = plan(store, shards, law, cost)
    # Spark writes no two files of one name; paths are spelt in several ways. A union of files, as this returns, has no _metadata.
    left = store.where(new != F.col("shard")).select(F.input_file_name().alias("file")).distinct()
    names = {unquote(r["file"].rsplit("/", 1)[1]) for r in left.collect()}
    every = {unquote(f.rsplit("/", 1)[1]): f for f in store.inputFiles()}
    files = sorted(f for n, f in every.items() if n in names)
    kept_files = sorted(f for n, f in every.items() if n not in names)
    out = spark.read.schema(store.schema).parquet(*kept_files) if kept_files else None
    if files:
        path = keep_until_clear(shared_dir(spark))
        _write(spark.read.schema(store.schema).parquet(*files).withColumn("shard", new), path)
        fresh = spark.read.schema(store.schema).parquet(path)
        out = fresh if out is None else out.unionByName(fresh)
    out = store if out is None else out
    return out.withColumn("law", F.lit(law))


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): slots number a shard's rows in its order, from 0.

    Sizes and checksums are taken of the texts that stand in the files.
    """
    block = F.shiftright("hash", 54)
    text = F.coalesce("doc.text", F.lit(""))
    x = rows.select("doc.doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), "law", "shard", "class", block.alias("block"), "hash")
    counts = x.groupBy("shard", "class", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("shard", "class", "block").orderBy("hash", "doc_id", "text_crc32")
    slot = (F.col("before") + F.row_number().over(own) - 1).cast("long")
    met = x.join(counts, ["shard", "class", "block"])
    return met.select("doc_id", "size", "text_crc32", "law", "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
