"""Line deduplication by winnowing.

The lines of a document that hold a word are a sequence of hashes. A window is the shortest run of lines from a line on that has
`min_words` words; of each window the smallest line hash is selected as a fingerprint (ties: the last). Any run of that many
words which occurs twice holds the same windows twice, hence the same fingerprints, so no such repeat is missed. Fingerprints
are joined: windows whose fingerprint occurs at one place only are out. The others are compared by their whole content, which
verifies the match; matching windows that overlap extend it in both directions. Windows are also read from the end: the shortest
run of lines up to a line. Every line of a repeated run of `min_words` words lies in a window of one of the two kinds within the
run, so together they reach both its ends (with `ends=False`, only the ends of the windows by first lines). The first
occurrence (smallest doc_id, then line) of a window stays, the lines of later ones go.

DataFrame expressions only; what is shuffled are hashes and positions, and no group is ever gathered: firsts are minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE, join_split, kept, scratch, stored

#: A repeated passage counts from so many words.
MIN_WORDS = 50


def numbered(docs: DataFrame) -> DataFrame:
    """(doc struct, key): every row with its doc_id and a number, stored, so that rows which share a doc_id stay apart.

    The key is null where doc_id is.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row")))
    return stored(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"), key.alias("key")))


def sequence(rows: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line, h, g, words) for lines with words; doc_id is a row's key, lines count from 0 and differ by more than white space at their ends."""
    lines = rows.where(F.col("key").isNotNull()).select(F.col("key").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col("doc")[text], F.lit("")), "\n")).alias("line", "x"))
    bare = F.regexp_replace("x", f"^[{SPACE}]+|[{SPACE}]+$", "")
    return lines.select("doc_id", "line", bare.alias("x")).where("x != ''").select("doc_id", "line", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(11), "x").alias("g"), F.size(F.split("x", f"[{SPACE}]+")).alias("words"))


def windows(lines: DataFrame, min_words: int, ends: bool = True) -> DataFrame:
    """(doc_id, line, last, fingerprint, place, content): complete windows, by the line they begin with and, with `ends`, by the line they end with.

    A run of lines by its end that is as short as can be from its first line, too, is there once. content, content2: two hashes of the
    window's lines in order.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    before = F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    x = lines.withColumn("at", before).withColumn("upto", F.col("at") + F.col("words")).withColumn("total", F.sum("words").over(Window.partitionBy("doc_id")))
    least = lambda span: F.min(F.struct("h", (-F.col("line")).alias("back"))).over(span)
    body = lambda span: F.collect_list(F.struct("h", "g")).over(span)
    run = lambda line, last, m, one, two: F.struct(line.alias("line"), last.alias("last"), m["h"].alias("fingerprint"), (-m["back"]).alias("place"), one.alias("content"), two.alias("content2"))
    span = Window.partitionBy("doc_id").orderBy("at").rangeBetween(0, min_words - 1)
    ahead = run(F.col("line"), F.max("line").over(span), least(span), F.xxhash64(body(span)), F.xxhash64(F.lit(13), body(span)))
    runs = [F.when(F.col("total") - F.col("at") >= min_words, ahead)]
    if ends:
        # The lines that reach into the last `min_words` up to a line's end; without the line they still have as many words.
        span = Window.partitionBy("doc_id").orderBy("upto").rangeBetween(1 - min_words, 0)
        back = run(F.min("line").over(span), F.col("line"), least(span), F.xxhash64(F.lit(17), body(span)), F.xxhash64(F.lit(19), body(span)))
        runs.append(F.when(F.sum("words").over(span) - F.col("words") >= min_words, back))
    found = x.select("doc_id", F.array(*runs).alias("runs"))
    return found.select("doc_id", F.explode("runs").alias("r")).where("r IS NOT NULL").select("doc_id", "r.*")


def repeats(rows: DataFrame, min_words: int = MIN_WORDS, text: str = "text", ends: bool = True) -> DataFrame:
    """(doc_id, start, end, first_doc, first_line): windows of lines that are to go, end inclusive, and where they stay; by key.

    Fingerprints and contents that very many windows have are joined apart, so no task gathers the windows of one.
    """
    with scratch(rows.sparkSession):
        found = stored(windows(sequence(rows, text), min_words, ends))
        # A fingerprint is a place; windows that share it count once.
        place = F.struct("doc_id", "place")
        places = found.groupBy("fingerprint").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("c"))
        shared = stored(places.where("lo != hi").select("fingerprint", "c"))
        hot = kept(join_split(found, shared, ["fingerprint"], "c", found.count()))
        window = F.struct("doc_id", "line", "last")
        first = hot.groupBy("content", "content2").agg(F.min(window).alias("f"), F.count("*").alias("c")).where("c > 1")
        first = kept(first.select("content", "content2", "f", "c"))
        total = hot.count()
    later = join_split(hot, first, ["content", "content2"], "c", total).where(window != F.col("f"))
    # In a run that repeats itself a later window may overlap the first: the lines of the first stay.
    inside = (F.col("doc_id") == F.col("f.doc_id")) & (F.col("line") <= F.col("f.last"))
    start = F.when(inside, F.col("f.last") + 1).otherwise(F.col("line"))
    later = later.select("doc_id", start.alias("start"), F.col("last").alias("end"), F.col("f.doc_id").alias("first_doc"), F.col("f.line").alias("first_line"))
    return later.where("start <= end")


def removed(rows: DataFrame, min_words: int = MIN_WORDS, text: str = "text", ends: bool = True) -> DataFrame:
    """(doc_id, runs): for each row of `numbered` that loses lines, by key, its runs, array<struct<start,end>>, disjoint and in order.

    Rows of one document are gathered by their runs, after windows that follow each other have been merged.
    """
    r = repeats(rows, min_words, text, ends).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    w = Window.partitionBy("doc_id").orderBy("start")
    open_ = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("new", F.when(F.coalesce(F.col("start") > open_ + 1, F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    runs = r.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", ends: bool = True) -> DataFrame:
    """`docs` without the lines that repeat earlier ones, and with `runs`, those that went (empty if none).

    Null texts stay null. Rows with a null doc_id are left alone. Rows that share a doc_id are texts of their own, in the order
    in which they are read: of equal rows the first keeps its lines. A column named runs gives way.
    """
    rows = numbered(docs.drop("runs"))
    gone = removed(rows, min_words, text, ends).withColumnRenamed("doc_id", "key")
    x = rows.join(gone, "key", "left").select("doc.*", F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")).alias("runs"))
    one = F.array(F.split(F.col(text), "\n"))
    bounds = F.concat(F.array(F.lit(-1)), F.transform("runs", lambda r: r["end"]))
    keep = F.transform(one, lambda ls: F.flatten(F.transform(bounds, lambda e, k: F.slice(ls, e + 2, F.coalesce(F.get(F.col("runs"), k)["start"], F.size(ls)) - e - 1))))
    return x.withColumn(text, F.when(F.size("runs") > 0, F.array_join(F.get(keep, F.lit(0)), "\n")).otherwise(F.col(text)))


def digest(done: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_removed lines, removed (their runs as start-end, comma-joined) and the text that stays."""
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"] + 1)
    return done.select("doc_id", n.alias("n_removed"), F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("removed"), F.col(text).alias("text"))
