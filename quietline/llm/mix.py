"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source has a target of words. Whole epochs of it are taken first; the rest is a draw without replacement. The corpus is
dealt by hash over 2**depth output shards, and a source's quota is split over them down a binary tree: a node that holds `q` of
the quota and `a` + `b` words below its two children passes on a hypergeometric draw of the `a` to the left, what is left to the
right. So the quotas of the leaves are exact, add up to the source's, and together are one multivariate-hypergeometric draw,
without anything global being sorted. Each leaf then takes its own permuted blocks (runs of at most `block_words` words of a
document) until its quota is full; the last one is cut. Leaves are disjoint, and so are their blocks.

The draw is by rejection from a hat that holds for every log-concave distribution of whole numbers, so one way serves all sizes:
with p the probability of the mode m, that of m + k is at most p * min(1, exp(1 - p |k|)). It takes five tries at most on average.

DataFrame expressions only. Texts are never shuffled to plan; what is grouped are rows of a few numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE, kept, scratch, stored, tasks, words_of

#: Weights by the rank of a source in code-point order, null last; they repeat.
WEIGHTS = (3, 1, 2)
#: Words of a block at most, and blocks of a shard on average.
BLOCK_WORDS, SHARD_BLOCKS = 4096, 1024
#: Levels of the tree that one row splits, and tries of a draw: all of them fail with a chance below 1e-49.
BAND, TRIES = 8, 512


def unit(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets stand in the ratio of the weights and add up to `share` of all words, but none exceeds `cap` times its source; what
    is over is dealt again by weight. Ordered by cap / weight, the capped sources come first, so running sums find the level
    at which the others stand. One row a source: the windows hold no more than that.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).cast("double")
    x = sizes.select("source", "source_size", w.alias("w"), (F.lit(cap) * F.col("source_size")).alias("cap"), (F.lit(share) * F.sum("source_size").over(Window.partitionBy())).alias("all"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(0, Window.unboundedFollowing)
    x = x.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(Window.partitionBy())["level"]
    return x.select("source", "source_size", F.least("cap", F.coalesce(free * F.col("w"), F.col("cap"))).alias("target"))


def let(x: Column, f) -> Column:
    """Bind a value once: a plain reference inside a higher-order function is evaluated for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def stirling(x: Column) -> Column:
    """log(x!) - x log(x) + x for a whole number as a double: from a table, then by Stirling's series, whose next term is below 1e-16."""
    table = F.array(*(F.lit(math.lgamma(k + 1) - (k * math.log(k) - k if k else 0.0)) for k in range(16)))
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return F.when(x < 16, F.get(table, x.cast("int"))).otherwise(F.log(x * (2 * math.pi)) / 2 + series)


def deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x, without the loss of digits near the mean."""

    def near(v: Column) -> Column:
        y = v * v
        sums = F.lit(1 / 19)
        for k in range(17, 1, -2):
            sums = sums * y + 1 / k
        return (x - mean) * v + 2 * x * v * y * sums

    far = F.when(x > 0, x * F.log(x / mean)).otherwise(F.lit(0.0)) + mean - x
    close = F.abs(x - mean) < (x + mean) * 0.1
    return F.when(close & (x > 0), let((x - mean) / (x + mean), near)).otherwise(far)


def log_probability(x: Column, quota: Column, left: Column, right: Column) -> Column:
    """Logarithm of the chance that x of `quota` drawn from `left` + `right` come from the left, to some 1e-13 at any size.

    All are doubles. It is a sum over the four cells of the table (drawn or not, left or right), each held against its mean.
    """
    n = left + right
    out = n - quota
    whole = stirling(left) + stirling(right) + stirling(quota) + stirling(out) - stirling(n)
    cell = lambda of, side, drawn: F.struct(of.alias("x"), (side * drawn / n).alias("mean"))
    cells = F.array(cell(x, left, quota), cell(left - x, left, out), cell(quota - x, right, quota), cell(right - quota + x, right, out))
    return whole - F.aggregate(cells, F.lit(0.0), lambda s, c: s + stirling(c["x"]) + deviance(c["x"], c["mean"]))


def hypergeometric(key: Column, quota: Column, left: Column, right: Column) -> Column:
    """How many of `quota` drawn from `left` + `right` come from the left: an exact draw, fixed by `key`.

    With w = 1 + p / 2 a try is y = w u / p with chance w / (1 + w), else (w + e) / p with an exponential e; k is y rounded, with
    a random sign, and is taken with the ratio of its chance to the hat at y.
    """
    k, a, b = quota.cast("double"), left.cast("double"), right.cast("double")
    lo, hi = F.greatest(F.lit(0.0), k - b), F.least(k, a)
    mode = F.least(hi, F.greatest(lo, F.floor((k + 1) * (a + 1) / (a + b + 2)).cast("double")))

    def draw(m: Column, top: Column) -> Column:
        p = F.exp(top)
        w = 1 + p / 2

        def attempt(i: Column) -> Column:
            u = lambda j: unit(j, key, i)
            y = F.when(u(0) * (1 + w) < w, w * u(1) / p).otherwise((w - F.log(1 - u(1))) / p)
            x = let(y, lambda y: F.struct((m + F.when(u(2) < 0.5, F.round(y)).otherwise(-F.round(y))).alias("x"), F.least(F.lit(0.0), w - p * y).alias("hat")))
            fits = lambda c: (c["x"] >= lo) & (c["x"] <= hi)
            taken = lambda c: F.log(1 - u(3)) + c["hat"] <= log_probability(c["x"], k, a, b) - top
            return let(x, lambda c: F.when(fits(c), F.when(taken(c), c["x"])))

        tries = F.sequence(F.lit(1), F.lit(TRIES))
        found = F.aggregate(tries, F.lit(None).cast("double"), lambda s, i: F.when(s.isNotNull(), s).otherwise(attempt(i)))
        return F.coalesce(found, m)

    drawn = let(mode, lambda m: let(log_probability(m, k, a, b), lambda top: draw(m, top)))
    plain = F.when((quota <= 0) | (left <= 0), F.lit(0.0)).when(right <= 0, k).when(quota >= left + right, a)
    return plain.when(lo == hi, lo).otherwise(drawn).cast("long")


def dealt(quota: Column, words: Column, levels: int, key: Column) -> Column:
    """Quotas of 2**levels children, whose words are the array `words`: a binary tree of draws."""

    def level(sums: Column):
        def down(quotas: Column, at: Column) -> Column:
            span = F.get(F.array(*(F.lit(1 << levels - 1 - i) for i in range(levels))), at)  # children below one side
            below = lambda i: F.get(sums, (i + 1) * span) - F.get(sums, i * span)

            def sides(q: Column, i: Column) -> Column:
                left = hypergeometric(F.xxhash64(key, at, i), q, below(2 * i), below(2 * i + 1))
                return let(left, lambda x: F.array(x, q - x))

            return F.flatten(F.transform(quotas, sides))

        return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), F.array(quota), down)

    running = F.aggregate(words, F.array(F.lit(0).cast("long")), lambda s, w: F.concat(s, F.array(F.get(s, F.size(s) - 1) + w)))
    return let(running, level)


def split(leaves: DataFrame, roots: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source, shard, quota): the quota of every leaf, from (source, shard, words) and (source, quota).

    A row splits `BAND` levels at once, so 2**BAND children at most; the rows of a step are dealt over all tasks.
    """
    spark = leaves.sparkSession
    down = roots.select("source", F.lit(0).cast("long").alias("node"), "quota")
    for top in range(0, depth, BAND):
        levels = min(BAND, depth - top)
        child = F.shiftright("shard", depth - top - levels)
        below = leaves.groupBy("source", child.alias("child")).agg(F.sum("words").alias("words"))
        entry = F.struct(F.col("child").bitwiseAND(F.lit((1 << levels) - 1)).alias("k"), "words")
        each = below.groupBy("source", F.shiftright("child", levels).alias("node")).agg(F.map_from_entries(F.collect_list(entry)).alias("words"))
        on = F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.node") == F.col("d.node"))
        x = each.alias("p").join(down.alias("d"), on).select("p.source", "p.node", "words", "quota").repartition(tasks(spark), "source", "node")
        every = F.sequence(F.lit(0).cast("long"), F.lit((1 << levels) - 1).cast("long"))
        full = let(F.col("words"), lambda m: F.transform(every, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0).cast("long"))))
        key = F.xxhash64(F.lit(seed), F.lit("tree"), F.lit(top), "source", "node")
        quotas = dealt(F.col("quota"), full, levels, key)
        down = x.select("source", "node", F.posexplode(quotas).alias("k", "quota"))
        down = down.where("quota > 0").select("source", ((F.col("node") * (1 << levels)) + F.col("k")).alias("node"), "quota")
        down = stored(down)
    return down.select("source", F.col("node").alias("shard"), "quota")


def plan(docs: DataFrame, seed: int = 17, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, text: str = "text") -> DataFrame:
    """One row a document and copy of it in the table: doc_id, source, size, source_size, target, copy, epochs, drawn, shard, place.

    The mix takes `epochs` whole copies and the word runs `drawn` (array<struct<start,end>>, at most one epoch) of each. Null
    texts have size 0 and are never drawn. Rows with the same doc_id, source and size are told apart by number. The same
    input, in any order or partitioning, gives the same plan.
    """
    doc_id, source = F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")
    sized = docs.select(doc_id, source, F.size(words_of(F.col(text))).cast("long").alias("size"))
    with scratch(docs.sparkSession):
        rows = kept(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
        per_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
        goal = targets(per_source, share, cap, weights)
        whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
        left = (F.round("target") - F.col("epochs") * F.col("source_size")).cast("long")
        goal = kept(goal.withColumn("epochs", whole).withColumn("quota", left))

        last = F.expr(f"(size - 1) div {block_words}")
        blocks = (
            rows.where("size > 0")
            .select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
            .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
            .withColumn("at", F.xxhash64(F.lit(seed), "source", "doc_id", "size", "copy", "block"))
        )
        n = rows.agg(F.sum(F.col("copies") * F.expr(f"(size + {block_words} - 1) div {block_words}"))).first()[0] or 0
        depth = max(0, math.ceil(math.log2(max(1, n / shard_blocks))))
        blocks = blocks.withColumn("shard", F.shiftrightunsigned("at", 64 - depth) if depth else F.lit(0).cast("long"))
        leaves = stored(blocks.groupBy("source", "shard").agg(F.sum("words").alias("words")))
        quota = kept(split(leaves, goal.select("source", "quota"), depth, seed))

    order = F.xxhash64(F.lit(seed + 1), "at", "doc_id", "copy", "block")
    filled = Window.partitionBy("source", "shard").orderBy(order, "doc_id", "copy", "block").rowsBetween(Window.unboundedPreceding, -1)
    drawn = blocks.withColumn("before", F.coalesce(F.sum("words").over(filled), F.lit(0))).alias("b")
    on = F.col("b.source").eqNullSafe(F.col("q.source")) & (F.col("b.shard") == F.col("q.shard"))
    drawn = drawn.join(quota.alias("q"), on, "left")
    take = F.least("words", F.greatest(F.lit(0).cast("long"), F.coalesce("quota", F.lit(0).cast("long")) - F.col("before")))
    run = F.struct((F.col("block") * block_words).alias("start"), (F.col("block") * block_words + F.col("take")).alias("end"))
    runs = drawn.select("doc_id", "b.source", "size", "copy", "b.shard", "block", take.alias("take")).groupBy("doc_id", "source", "size", "copy")
    # The blocks of one document: its words over `block_words`.
    runs = runs.agg(F.array_sort(F.collect_list(F.when(F.col("take") > 0, run))).alias("drawn"), F.min_by("shard", "block").alias("shard"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>").alias("drawn")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    empty = rows.where("size = 0").select("doc_id", "source", "size", copies, none, F.lit(0).cast("long").alias("shard"))
    every = runs.select("doc_id", "source", "size", "copy", "drawn", "shard").unionByName(empty).alias("r")
    out = every.join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    epochs = F.when(F.col("size") > 0, F.col("epochs")).otherwise(0).cast("long").alias("epochs")
    place = F.xxhash64(F.lit(seed + 2), "doc_id", "copy").alias("place")
    return out.select("doc_id", "r.source", "size", "source_size", "target", "copy", epochs, "drawn", "shard", place)


def taken(planned: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, repeats counted."""
    words = F.col("epochs") * F.col("size") + F.aggregate("drawn", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return planned.select("doc_id", "size", "source_size", "target", words.alias("taken"))


def mixed(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each epoch of a document, and one with the drawn runs of words.

    A drawn row keeps the text's own spacing; its `n_chars`, if there is one, is counted again. Rows come out shuffled
    within their shards. Columns of `docs` may have any names: they travel in one struct.
    """
    runs = "array<struct<start:bigint,end:bigint>>"
    none = F.array().cast(f"array<{runs}>")
    p = plan(docs, text=text, **options).groupBy("doc_id", "source", "size")
    some = F.when(F.size("drawn") > 0, F.array("drawn")).otherwise(none)
    p = p.agg(F.flatten(F.collect_list(some)).alias("draws"), F.first("epochs").alias("epochs"), F.count("*").alias("copies"), F.min("shard").alias("shard"), F.min("place").alias("place")).alias("p")
    whole = F.struct(*(F.col(c) for c in docs.columns))
    d = docs.select(whole.alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("of"), F.size(words_of(F.col(text))).cast("long").alias("words")).alias("d")
    on = F.col("d.id").eqNullSafe(F.col("p.doc_id")) & F.col("d.of").eqNullSafe(F.col("p.source")) & (F.col("d.words") == F.col("p.size"))
    j = d.join(p, on).select("doc", "id", "of", "words", "draws", "epochs", "copies", "shard", "place")
    body = F.col("doc")[text]
    number = F.row_number().over(Window.partitionBy("id", "of", "words").orderBy(F.xxhash64(body)))
    j = j.where("copies = 1").withColumn("n", F.lit(1)).unionByName(j.where("copies > 1").withColumn("n", number))
    own = F.when(F.col("n") <= F.size("draws"), F.slice("draws", F.col("n"), F.lit(1))).otherwise(none)
    parts = F.concat(F.array_repeat(F.lit(None).cast(runs), F.col("epochs").cast("int")), own)
    j = j.select("doc", "words", "shard", "place", F.explode(parts).alias("part"))
    pieces = F.split(body, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    piece = lambda w: F.transform("part", lambda r: F.slice(w, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))
    cut = let(pieces, lambda w: F.array_join(F.flatten(piece(w)), ""))
    first = F.get(F.col("part"), F.lit(0))
    full = F.col("part").isNull() | ((F.size("part") == 1) & (first["start"] == 0) & (first["end"] == F.col("words")))
    new = F.when(full, body).otherwise(F.regexp_replace(cut, f"^[{SPACE}]+", ""))
    j = j.select("doc", "shard", "place", full.alias("full"), new.alias("new")).sortWithinPartitions("shard", "place")
    out = {c: F.col("doc")[c] for c in docs.columns} | {text: F.col("new")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("full"), out["n_chars"]).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)
    return j.select(*(x.alias(c) for c, x in out.items()))
