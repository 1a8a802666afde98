"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of `size` consecutive words; an item with fewer words is one window. An occurrence must contain every
word of a window, so after the window's words are put in order of rarity a prefix of one word is enough: a document that lacks
the rarest word of a window can't hold it. The join is on that word alone. Its place in the window fixes where an occurrence
would begin, which gives the positional bound (the start isn't negative) and the length bound (the end lies in the document);
what is left is held against the window's word hashes, and then verified word by word in the text.

Rarity is document frequency over the whole corpus, counted for all windows at once; the words go to the tasks in blocks of
`VOCABULARY_BLOCK`. The windows go there in blocks of at most `block_windows` distinct ones, a proven bound on what is broadcast;
a larger benchmark takes more blocks, which a document passes one after another. Which items have a window is a joined table.
Documents are never shuffled, but for the keys of those that hold a window.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep_until_clear, kept, scratch, shared_dir, stored
from .texthash import slices, words

#: Words: runs of ASCII letters and digits and of everything above ASCII. A-Z alone is lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Windows that are broadcast at once, and words.
BLOCK_WINDOWS, VOCABULARY_BLOCK = 100_000, 4_000_000
SPANS = "array<struct<start:int,end:int>>"


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


def item_windows(items: DataFrame, size: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """(item, w, hs): the distinct windows of every item, with the hashes of their words; items without words have none."""

    def cut(batches):
        for b in batches:
            for part in slices(b, "t"):
                rows = []
                for i, t in zip(part["item"].to_pylist(), part["t"].to_pylist(), strict=True):
                    w = words_in(t)
                    own = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else ()
                    rows += [(i, x) for x in sorted(own)]
                flat = pa.array([" ".join(x) for _, x in rows], pa.string())
                h, counts = words(flat, separators=SEPARATORS)
                hs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), flat, hs], names=["item", "w", "hs"])

    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("t"))
    return rows.mapInArrow(cut, "item string, w string, hs array<long>").distinct()


def word_frequency(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> DataFrame:
    """(h, n): in how many documents each word of a vocabulary (ascending hashes) occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for part in slices(b, text):
                h, counts = words(part[text], separators=SEPARATORS)
                if len(h) and len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    own = known[at] == h
                    of = np.repeat(np.arange(len(counts), dtype=np.int64), counts)[own]
                    once = np.unique(of * len(known) + at[own]) % len(known)
                    total += np.bincount(once, minlength=len(known))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[own].view(np.int64)), pa.array(total[own])], names=["h", "n"])

    return docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def indexed(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """(window, w, hs, place): the distinct windows, by a hash of their words, with the place of their rarest word.

    Of words as rare as each other the one with the smaller hash is taken, then the first place.
    """
    distinct = windows.select("w", "hs").dropDuplicates(["w"]).withColumn("window", F.xxhash64("w"))
    vocabulary = stored(windows.select(F.explode("hs").alias("h")).distinct())
    blocks = max(1, -(-vocabulary.count() // VOCABULARY_BLOCK))
    frequency = None
    for k in range(blocks):
        block = vocabulary.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == k).toArrow()["h"].to_numpy().view(np.uint64)
        some = word_frequency(docs, np.sort(block), text)
        frequency = some if frequency is None else frequency.unionByName(some)
    each = distinct.select("window", F.posexplode("hs").alias("place", "h")).join(stored(frequency), "h", "left")
    rarest = each.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place"))["place"].alias("place"))
    return distinct.join(rarest, "window")


class Index:
    """Windows by their rarest word, as arrays."""

    def __init__(self, rows: pa.Table):
        hs = rows["hs"].combine_chunks()
        flat, at = hs.flatten().to_numpy().view(np.uint64), hs.offsets.to_numpy() - hs.offsets[0].as_py()
        place = rows["place"].to_numpy().astype(np.int64)
        rare = flat[at[:-1] + place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(rare, kind="stable")
        self.rare, self.first = np.unique(rare[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.place, self.size = place[order], np.diff(at)[order]
        # Hashes of the words, row by row, as wide as the longest window.
        width = int(self.size.max()) if len(order) else 0
        self.hashes = np.zeros((len(order), width), np.uint64)
        for k in range(width):
            own = self.size > k
            self.hashes[own, k] = flat[at[:-1][order][own] + k]
        self.window = rows["window"].to_numpy()[order]
        self.text = rows["w"].combine_chunks().take(pa.array(order))

    def candidates(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, row): where the words' hashes are those of a window; `start` counts from the text's first word."""
        none = np.zeros(0, np.int64)
        if not len(h) or not len(self.rare):
            return none, none, none
        slot = np.minimum(np.searchsorted(self.rare, h), len(self.rare) - 1)
        at = np.flatnonzero(self.rare[slot] == h)
        slot = slot[at]
        many = self.last[slot] - self.first[slot]
        at, row = np.repeat(at, many), np.repeat(self.first[slot] - np.cumsum(many) + many, many) + np.arange(many.sum())
        ends = np.cumsum(counts)
        of = np.searchsorted(ends, at, side="right")
        start = at - self.place[row]
        # The positional bound, then the length bound.
        own = (start >= (ends - counts)[of]) & (start + self.size[row] <= ends[of])
        of, start, row = of[own], start[own], row[own]
        for k in range(self.hashes.shape[1]):
            own = (self.size[row] <= k) | (h[np.minimum(start + k, len(h) - 1)] == self.hashes[row, k])
            of, start, row = of[own], start[own], row[own]
        return of, start - (ends - counts)[of], row

    def occurrences(self, texts: pa.Array, of: np.ndarray, start: np.ndarray, row: np.ndarray):
        """(text, start, end, window) of the candidates whose words are those of the window."""
        held, own = None, []
        for d, i, r in zip(of.tolist(), start.tolist(), row.tolist(), strict=True):
            if d != held:
                held, own = d, words_in(texts[d].as_py())
            j = i + int(self.size[r])
            if " ".join(own[i:j]) == self.text[r].as_py():
                yield d, i, j, int(self.window[r])


def found_in(docs: DataFrame, index, text: str) -> DataFrame:
    """`docs`, which have n_words, spans and windows, with what the windows of an index add to them."""

    def match(batches):
        for b in batches:
            for part in slices(b, text):
                h, counts = words(part[text], separators=SEPARATORS)
                hits: dict[int, list] = {}
                for d, i, j, window in index.value.occurrences(part[text], *index.value.candidates(h, counts)):
                    hits.setdefault(d, []).append((i, j, window))
                spans, windows = part["spans"].to_pylist(), part["windows"].to_pylist()
                for d, own in hits.items():
                    merged = []
                    for s, e in sorted([(s, e) for s, e, _ in own] + [(x["start"], x["end"]) for x in spans[d]]):
                        if merged and s <= merged[-1]["end"]:
                            merged[-1]["end"] = max(e, merged[-1]["end"])
                        else:
                            merged.append({"start": s, "end": e})
                    spans[d], windows[d] = merged, sorted({w for *_, w in own}.union(windows[d]))
                new = {"n_words": pa.array(counts.astype(np.int64))}
                for c, x in (("spans", spans), ("windows", windows)):
                    new[c] = pa.array(x, part.schema.field(c).type)
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(k)) for k, c in enumerate(part.schema.names)], schema=part.schema)

    return docs.mapInArrow(match, docs.schema)


def matched(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(rows, windows): (doc struct, text, n_words, spans, windows array<long>) of each document, and (item, window)."""
    spark = docs.sparkSession
    whole = F.struct(*(F.col(c) for c in docs.columns))
    rows = docs.select(whole.alias("doc"), F.col(text).cast("string").alias("text"))
    with scratch(spark):
        windows = stored(item_windows(items, size))
        index = kept(indexed(rows, windows))
        total = index.count()
        blocks = max(1, -(-total // block_windows))
        # Windows are distinct, so more blocks divide any of them.
        block = lambda n: F.pmod(F.xxhash64(F.lit(3), "window"), F.lit(n))
        while total and max(r["count"] for r in index.groupBy(block(blocks)).count().collect()) > block_windows:
            blocks *= 2
        of = kept(windows.select("item", F.xxhash64("w").alias("window")))
    none = [F.array().cast(SPANS).alias("spans"), F.array().cast("array<long>").alias("windows")]
    rows = rows.select("doc", "text", F.lit(0).cast("long").alias("n_words"), *none)
    before = None
    for k in range(blocks):
        one = spark.sparkContext.broadcast(Index(index.where(block(blocks) == k).toArrow()))
        rows = found_in(rows, one, "text")
        if k + 1 < blocks:
            # A block's pass ends before the next block is sent, so driver and executors hold one, however many there are.
            path = keep_until_clear(shared_dir(spark))
            rows.write.parquet(path)
            one.destroy()
            rows = spark.read.schema(rows.schema).parquet(path)
            if before:
                drop(spark, before)
            before = path
    return rows, of


def find(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", block_windows: int = BLOCK_WINDOWS, columns: list[str] | None = None) -> DataFrame:
    """The columns of `docs` (or those named), and n_words long, spans array<struct<start,end>> (disjoint, ascending, in words), items array<string>.

    Null and empty texts have no words; an empty benchmark hits nothing; items with the same words are found together. The
    words of an item with a null item_id are hit like any other's, but it isn't listed in `items`, having no name. Columns
    of `docs` named n_words, spans or items give way.
    """
    rows, of = matched(docs, items, size, text, block_windows)
    rest = [c for c in columns or docs.columns if c not in ("n_words", "spans", "items")]
    own = [F.col("doc")[c].alias(c) for c in rest]
    doc = F.struct(*own) if own else F.lit(None).cast("int")
    # Stored, so that a row's number is the same for its windows and itself, and texts are read once.
    path = keep_until_clear(shared_dir(docs.sparkSession))
    rows.select(doc.alias("doc"), "n_words", "spans", "windows").withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    # Windows with the same items have one list of items, so one that many items share costs a document no more than another.
    named = of.where("item IS NOT NULL").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.withColumn("set", F.xxhash64("items"))
    hit = rows.where("size(windows) > 0")
    sets = hit.select("row", F.explode("windows").alias("window")).join(named.select("window", "set"), "window").select("row", "set").distinct()
    lists = sets.join(named.select("set", "items").dropDuplicates(["set"]), "set").groupBy("row")
    lists = lists.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<string>")
    found = hit.join(lists, "row", "left").withColumn("items", F.coalesce("items", none))
    done = found.unionByName(rows.where("size(windows) = 0").withColumn("items", none))
    return done.select(*(F.col("doc")[c].alias(c) for c in rest), "n_words", "spans", "items")


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def digest(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated from what `find` returns."""
    n_hit = hit_words(F.col("spans"))
    sha = F.sha2(F.array_join("items", ","), 256)
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), sha.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs` without the rows that hold a window of the benchmark; nothing is shuffled, and stored only if there are several blocks."""
    rows, _ = matched(docs, items, **options)
    return rows.where(F.size("spans") == 0).select(*(F.col("doc")[c].alias(c) for c in docs.columns))
