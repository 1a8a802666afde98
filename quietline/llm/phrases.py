"""Phrase collocations by contiguous pattern growth over projected occurrences.

Three passes read the texts, each in numpy over Arrow batches. The first counts words, the second counts pairs of frequent
words, the third projects: an occurrence of a frequent pair becomes its right context, the words that may follow as long as
each next pair is frequent too. Tasks sum equal contexts before they are shuffled, so a hot word or pair has one row for each
distinct context and task. Each prefix then belongs to one task, which has its contexts sorted: the occurrences of a prefix are
a range of them, its extensions split that range, and growth goes depth first from range to range (`grow`). Whole batches are
grown at a time and what is open at a batch's end is carried over, so a task holds a batch, however many contexts a prefix has.

Frequent words and pairs reach the tasks as bitmaps of a fixed number of hash buckets. A bucket that is set by mistake lets a
context through that the exact counts then drop, so the bitmaps prune and decide nothing.

Words are told apart by 64-bit hashes that include the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import texthash
from .shared import stored, tasks

#: Bits of a bitmap of frequent hashes: 8 MB, whatever the corpus.
BITS = 26
#: Entries that a task sums before it hands them on.
HELD = 1 << 19
LONGEST = 4

_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BREAK = _PIECE.copy()
_BREAK[[0x20, 0x09]] = True
_NONE = np.zeros(0, np.uint64)


def _words(batch: pa.RecordBatch):
    """(bytes, starts, ends, key of every word, its piece, its text): keys depend on the language, pieces never go over texts."""
    raw, starts, ends, bounds = texthash._marks(batch["text"], _BREAK)
    if not len(starts):
        return raw, starts, ends, _NONE, starts, starts
    text = np.searchsorted(bounds, starts, side="right") - 1
    lang = batch["lang_key"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[text]
    keys = texthash.mix(texthash._hashes(raw, starts, ends, True) * texthash.MULTIPLIER + lang)
    keys[keys == 0] = np.uint64(1)  # 0 stands for no word
    piece = np.cumsum(_PIECE[raw], dtype=np.int64)[starts] + text
    return raw, starts, ends, keys, piece, text


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of each word with the one after it."""
    with np.errstate(over="ignore"):
        return texthash.mix(first * texthash.MULTIPLIER + second)


def _summed(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of uint64, the last column a count: equal rows become one with the sum of their counts.

    Rows are put in order of a hash, so two rows whose hashes clash may stay apart; the sums after the shuffle are exact. The
    list is emptied.
    """
    x = np.concatenate(rows)
    rows.clear()
    if not len(x):
        return x
    h = x[:, 0]
    for j in range(1, x.shape[1] - 1):
        h = texthash.mix(h * texthash.MULTIPLIER + x[:, j])
    x = x[np.argsort(h)]
    first = np.flatnonzero(np.concatenate([[True], (x[1:, :-1] != x[:-1, :-1]).any(axis=1)]))
    out = x[first]
    out[:, -1] = np.add.reduceat(x[:, -1], first)
    return out


def _batches(x: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in batches that are small enough to be many at once on their way."""
    for k in range(0, len(x), 1 << 15):
        yield _batch(x[k : k + (1 << 15)], names)


def _batch(x: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, j]).view(np.int64)) for j in range(len(names))], names)


def _counted(batches: Iterator[pa.RecordBatch], rows_of, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What `rows_of` makes of every part of the batches, summed in the task as far as HELD allows."""
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        for part in texthash.slices(batch, "text"):
            x = rows_of(part)
            if len(x):
                held.append(_summed([x]))
                n += len(held[-1])
            if n > HELD:
                held = [_summed(held)]
                n = len(held[0])
                if n > HELD // 2:
                    yield from _batches(held[0], names)
                    held, n = [], 0
    if held:
        yield from _batches(_summed(held), names)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(spark: SparkSession, keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each hash bucket that holds a key; at most 2^BITS / 64 rows reach the driver."""
    bucket = F.shiftrightunsigned(F.col(key), 64 - BITS)
    word = keys.groupBy(F.shiftright(bucket, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, {64 - BITS}) & 63 as int))")).alias("b"))
    got = word.toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    return bits.view(np.uint8)


def words(docs: DataFrame) -> DataFrame:
    """(lang_key, key, word, n): occurrences of every word in a language."""

    def count(batches):
        for batch in batches:
            for part in texthash.slices(batch, "text", 8 << 20):
                raw, starts, ends, keys, _, text = _words(part)
                if not len(keys):
                    continue
                own, first, n = np.unique(keys, return_index=True, return_counts=True)
                # Words and what lies between them are the parts of one long string.
                offsets = np.empty(2 * len(starts) + 1, np.int64)
                offsets[0::2], offsets[1::2] = np.concatenate([starts, [ends[-1]]]), ends
                spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(texthash._LOWER[raw]))])
                spelt = spelt.take(pa.array(2 * first)).cast(pa.large_string()).cast(pa.string())
                lang = part["lang_key"].take(pa.array(text[first]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(own.view(np.int64)), spelt, pa.array(n.astype(np.int64))], ["lang_key", "key", "word", "n"])

    partial = docs.mapInArrow(count, "lang_key long, key long, word string, n long")
    return partial.groupBy("lang_key", "key").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def frequent_pairs(docs: DataFrame, word_bits, least: int) -> DataFrame:
    """(k1, k2, a): two adjacent frequent words that occur `least` times or more."""

    def rows(part):
        _, _, _, keys, piece, _ = _words(part)
        ok = _has(word_bits.value, keys)
        at = np.flatnonzero((piece[:-1] == piece[1:]) & ok[:-1] & ok[1:])
        return np.stack([keys[at], keys[at + 1], np.ones(len(at), np.uint64)], axis=1)

    partial = docs.mapInArrow(lambda batches: _counted(batches, rows, ["k1", "k2", "n"]), "k1 long, k2 long, n long")
    return partial.groupBy("k1", "k2").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def pair_hashes(pairs: DataFrame) -> DataFrame:
    """(pair): the hash of each pair that `projected` looks up."""

    def hashed(batches):
        for b in batches:
            k1, k2 = (b[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays([pa.array(_pair(k1, k2).view(np.int64))], ["pair"])

    return pairs.select("k1", "k2").mapInArrow(hashed, "pair long")


CONTEXT = [f"k{i}" for i in range(1, LONGEST + 1)]


def projected(docs: DataFrame, word_bits, pair_bits) -> DataFrame:
    """(k1 .. k4, n): each occurrence of a frequent pair with its right context, which ends before the first rare pair; 0 is no word.

    Contexts of two words are left out: their pairs are counted already, and nothing grows from them.
    """

    def rows(part):
        _, _, _, keys, piece, _ = _words(part)
        if len(keys) < 3:
            return np.zeros((0, LONGEST + 1), np.uint64)
        ok = _has(word_bits.value, keys)
        go = (piece[:-1] == piece[1:]) & ok[:-1] & ok[1:] & _has(pair_bits.value, _pair(keys[:-1], keys[1:]))
        at = np.flatnonzero(go[:-1] & go[1:])
        out = np.zeros((len(at), LONGEST + 1), np.uint64)
        out[:, 0], out[:, 1], out[:, 2], out[:, -1] = keys[at], keys[at + 1], keys[at + 2], 1
        on = np.ones(len(at), bool)
        padded = np.concatenate([go, np.zeros(LONGEST, bool)])
        for j in range(3, LONGEST):
            on &= padded[at + j - 1]
            out[on, j] = keys[at[on] + j]
        return out

    names = [*CONTEXT, "n"]
    partial = docs.mapInArrow(lambda batches: _counted(batches, rows, names), ", ".join(f"{c} long" for c in names))
    return partial.groupBy(*CONTEXT).agg(F.sum("n").alias("n"))


def extend(x: np.ndarray, n: np.ndarray, lo: int, hi: int, depth: int, least: int, out: list) -> None:
    """Grows the prefix of `depth` words that rows lo to hi share: each word that follows it often enough, and from there on.

    Rows are contexts in order, so the occurrences that go on with a word are a range of the range.
    """
    if depth == LONGEST or n[lo:hi].sum() < least:
        return
    col = x[lo:hi, depth]
    at = np.concatenate([[0], np.flatnonzero(col[1:] != col[:-1]) + 1, [hi - lo]]) + lo
    sums = np.add.reduceat(n[lo:hi], at[:-1] - lo)
    for j in np.flatnonzero(sums >= least):
        a, b = int(at[j]), int(at[j + 1])
        if x[a, depth]:
            out.append((*x[a, : depth + 1].tolist(), *[0] * (LONGEST - depth - 1), int(sums[j])))
            extend(x, n, a, b, depth + 1, least, out)


def grow(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(k1 .. k4, a): phrases of two words or more that occur `least` times, from contexts in order.

    Prefixes of two words are grown as soon as they are complete. One that has more contexts than a batch is grown by its
    complete longer prefixes, and only their sums are held.
    """
    names, kind = [*CONTEXT, "a"], pa.int64()
    x, n = np.zeros((0, LONGEST), np.int64), np.zeros(0, np.int64)

    def said(out):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names)

    def whole(x, n, out):
        """Grows the complete prefixes of two words."""
        at = np.concatenate([[0], np.flatnonzero((x[1:, :2] != x[:-1, :2]).any(axis=1)) + 1, [len(x)]])
        sums = np.add.reduceat(n, at[:-1])
        for j in np.flatnonzero(sums >= least):
            a, b = int(at[j]), int(at[j + 1])
            out.append((*x[a, :2].tolist(), *[0] * (LONGEST - 2), int(sums[j])))
            extend(x, n, a, b, 2, least, out)

    for batch in batches:
        more = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in CONTEXT], axis=1)
        x, n = np.concatenate([x, more]), np.concatenate([n, batch["n"].to_numpy(zero_copy_only=False)])
        if not len(x):
            continue
        out: list = []
        last = int(np.flatnonzero((x[:, :2] != x[-1, :2]).any(axis=1))[-1]) + 1 if (x[:, :2] != x[-1, :2]).any() else 0
        if last:
            whole(x[:last], n[:last], out)
            x, n = x[last:], n[last:]
        if len(x) > HELD // 8:  # one prefix of two words: its complete prefixes of three become one row each
            open_ = int(np.flatnonzero(x[:, 2] != x[-1, 2])[-1]) + 1 if (x[:, 2] != x[-1, 2]).any() else 0
            if open_:
                done = x[:open_], n[:open_]
                at = np.concatenate([[0], np.flatnonzero(done[0][1:, 2] != done[0][:-1, 2]) + 1])
                sums = np.add.reduceat(done[1], at)
                ends = [*at[1:].tolist(), open_]
                for j in np.flatnonzero(sums >= least):
                    if x[at[j], 2]:
                        out.append((*x[at[j], :3].tolist(), 0, int(sums[j])))
                        extend(*done, int(at[j]), ends[j], 3, least, out)
                # What is said already keeps its sum for the shorter prefix: word 0, which none extends.
                head = x[:1].copy()
                head[0, 2:] = 0
                x, n = np.concatenate([head, x[open_:]]), np.concatenate([[done[1].sum()], n[open_:]])
        if out:
            yield said(out)
    if len(x):
        out = []
        whole(x, n, out)
        yield said(out)


def counted(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang_key, key, word, n) of all words, and (k1 .. k4, a) of phrases of two to four words with a >= least."""
    spark = docs.sparkSession
    vocabulary = stored(words(docs))
    broadcasts = [spark.sparkContext.broadcast(bitmap(spark, vocabulary.where(F.col("n") >= least), "key"))]
    pairs = stored(frequent_pairs(docs, broadcasts[0], least))
    broadcasts.append(spark.sparkContext.broadcast(bitmap(spark, pair_hashes(pairs), "pair")))
    contexts = projected(docs, *broadcasts)
    by_prefix = contexts.repartition(tasks(spark), "k1", "k2").sortWithinPartitions(*CONTEXT)
    grown = by_prefix.mapInArrow(lambda b: grow(b, least), ", ".join(f"{c} long" for c in [*CONTEXT, "a"]))
    none = [F.lit(0).cast("long").alias(c) for c in CONTEXT[2:]]
    # What the contexts say of a pair is only the part that goes on.
    phrases = stored(grown.where("k3 <> 0").unionByName(pairs.select("k1", "k2", *none, "a")))
    for b in broadcasts:
        b.destroy()
    return vocabulary, phrases


def _part(lo: int, hi: int):
    """Words lo to hi of a phrase, as a phrase."""
    return [F.col(CONTEXT[i]) if i < hi else F.lit(0).cast("long") for i in range(lo, lo + LONGEST)]


def scored(vocabulary: DataFrame, phrases: DataFrame, share: int = 80) -> DataFrame:
    """(k1 .. k4, a, l, r, score) of phrases that no longer one covers.

    A phrase is cut where its score floor(2000000 * a / (l + r)) is lowest, ties after the fewest words. It goes if its words
    lie in a longer phrase that occurs `share` percent as often or more.
    """
    size = sum(F.when(F.col(c) != 0, 1).otherwise(0) for c in CONTEXT)
    p = phrases.withColumn("size", size)
    part = lambda cut, side, lo, hi: F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), *(c.alias(f"p{i}") for i, c in enumerate(_part(lo, hi), 1)))
    cuts = F.lit(None)
    for m in range(LONGEST, 1, -1):
        cuts = F.when(F.col("size") == m, F.array(*(x for k in range(1, m) for x in (part(k, "l", 0, k), part(k, "r", k, m))))).otherwise(cuts)
    parts = p.select(*CONTEXT, "a", F.explode(cuts).alias("x")).select(*CONTEXT, "a", "x.*")
    none = F.lit(0).cast("long")
    known = vocabulary.select(F.col("key").alias("p1"), *(none.alias(f"p{i}") for i in range(2, LONGEST + 1)), F.col("n").alias("f"))
    known = known.unionByName(phrases.select(*(F.col(c).alias(f"p{i}") for i, c in enumerate(CONTEXT, 1)), F.col("a").alias("f")))
    met = parts.join(known, [f"p{i}" for i in range(1, LONGEST + 1)])
    big = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)")
    at_cut = met.groupBy(*CONTEXT, "a", "cut").agg(F.sum(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.sum(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    at_cut = at_cut.withColumn("big", big).withColumn("score", F.expr("big div cast(l + r as decimal(20,0))"))
    best = at_cut.groupBy(*CONTEXT, "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select(*CONTEXT, "a", "b.l", "b.r", "b.score")
    inner = F.lit(None)
    within = lambda lo, hi: F.struct(*(c.alias(n) for c, n in zip(_part(lo, hi), CONTEXT, strict=True)))
    for m in range(LONGEST, 2, -1):
        inner = F.when(F.col("size") == m, F.array(*(within(lo, lo + k) for k in range(2, m) for lo in range(m - k + 1)))).otherwise(inner)
    longer = p.where("size > 2").select(F.explode(inner).alias("x"), "a").groupBy(*(F.col(f"x.{c}").alias(c) for c in CONTEXT)).agg(F.max("a").alias("longer"))
    return best.join(longer, CONTEXT, "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def mined(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `most` phrases of each language.

    Null texts and texts without words count for nothing; a null language is `und`, and so is a language of that name; repeated
    rows and ids count as often as they stand; further columns are ignored. An empty table, and a language without a phrase
    that is frequent enough, give no rows. Ties go by a, then by the phrase's bytes.
    """
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    read = docs.select(F.col("text"), F.xxhash64(lang).alias("lang_key"), lang.alias("lang"))
    vocabulary, phrases = counted(read.select("text", "lang_key"), least)
    names = read.select("lang_key", "lang").distinct()
    totals = vocabulary.groupBy("lang_key").agg(F.sum("n").alias("n")).join(names, "lang_key")
    spelt = vocabulary.where(F.col("n") >= least)
    key = spelt.select(F.col("key").alias("k1"), "lang_key", F.col("word").alias("w1"))
    x = scored(vocabulary, phrases).join(key, "k1")
    order = Window.partitionBy("lang_key").orderBy(F.desc("score"), F.desc("a"))
    x = x.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= most).drop("_r")  # with ties, before words are looked up
    for i in range(2, LONGEST + 1):
        x = x.join(spelt.select(F.col("key").alias(f"k{i}"), F.col("word").alias(f"w{i}")), f"k{i}", "left")
    x = x.withColumn("phrase", F.concat_ws(" ", *(f"w{i}" for i in range(1, LONGEST + 1))))
    order = Window.partitionBy("lang_key").orderBy(F.desc("score"), F.desc("a"), "phrase")
    x = x.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return x.join(totals, "lang_key").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
