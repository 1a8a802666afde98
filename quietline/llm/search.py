"""Ranked lexical search over block-max posting lists.

Documents are indexed in segments of some megabytes of text, each written by the task that reads them, so postings are never
shuffled to build the index. A term's postings in a segment lie in blocks of 128, packed in as few bits as their gaps and
counts need; in front stand, for each block, its first and last document and the largest impact of any of its postings.

A query is answered segment by segment. Lists are put in order of the most that they can add; those whose sum stays below the
threshold can't make a document a hit alone, so documents come from the other lists (the pivot test of WAND). Of these lists
only blocks are unpacked where the maxima of the blocks that lie side by side, summed over all lists by stretches of documents
without unpacking anything, reach the threshold. Each document in them then gets a bound from the one block of each list that
may hold it, and the remaining lists are unpacked in blocks that hold a document whose bound reaches the threshold. All of a
segment's documents take each step together, in numpy. The threshold starts at a bound from block maxima of the whole corpus,
and rises with what a segment finds, first in the best blocks of the lists that can add most. A bound that equals the threshold is never skipped, as ties go by doc_id; so results are exact.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import texthash
from .shared import kept, scratch, stored, tasks

#: Characters of terms: ASCII letters and digits, and everything beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
for _lo, _hi in ("09", "AZ", "az"):
    _BREAK[ord(_lo) : ord(_hi) + 1] = False

BLOCK = 128
#: A segment ends with the document that takes its text beyond this, or at this many documents.
SEGMENT_BYTES, SEGMENT_DOCS = 16 << 20, 1 << 16
#: Stretches of a segment's documents over which block maxima are summed, and lists whose best blocks are read first.
STRETCHES, SEEDS = 64, 3
#: Terms of items that one search takes to the tasks; more items take more searches, one after the other.
QUERY_TERMS = 200_000

HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("most", "<u4"), ("at", "<u4"), ("n", "u1"), ("gap", "u1"), ("tf", "u1")])
INDEX = "segment long, term long, n long, head binary, body binary"


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, number of terms of each text)."""
    return texthash.words(texts, separators=_BREAK)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _width(x: np.ndarray) -> np.ndarray:
    """Bits that numbers need."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def packed(docs: np.ndarray, tfs: np.ndarray, scores: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(heads, bytes, first head of each list, first byte of each head) of postings in order, whose lists begin at `lists`."""
    size = np.diff(np.append(lists, len(docs)))
    blocks = -(-size // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    inside = np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)
    start = np.repeat(lists, blocks) + inside * BLOCK
    count = np.minimum(BLOCK, np.repeat(lists + size, blocks) - start)
    gap = np.diff(docs, prepend=docs[:1])
    gap[start] = 0
    head = np.zeros(len(start), HEAD)
    head["first"], head["last"], head["most"], head["n"] = docs[start], docs[start + count - 1], np.maximum.reduceat(scores, start), count
    gw, tw = _width(np.maximum.reduceat(gap, start)), _width(np.maximum.reduceat(tfs, start) - 1)
    head["gap"], head["tf"] = gw, tw
    size_bytes = (count * (gw + tw) + 7) // 8
    at = np.concatenate([[0], np.cumsum(size_bytes)])
    # Offsets count from the begin of the list's own bytes.
    head["at"] = at[:-1] - np.repeat(at[first_block[:-1]], blocks)
    bits = np.zeros(int(at[-1]) * 8, np.uint8)
    place = np.arange(len(docs)) - np.repeat(start, count)
    base = np.repeat(at[:-1] * 8, count)
    for values, own, skip in ((gap, gw, None), (tfs - 1, tw, count * gw)):
        w = np.repeat(own, count)
        to = base + place * w + (0 if skip is None else np.repeat(skip, count))
        for b in range(int(w.max(initial=0))):
            k = np.flatnonzero(w > b)
            bits[to[k] + b] = (values[k] >> b) & 1
    return head, np.packbits(bits, bitorder="little"), first_block, at


class Postings:
    """A term's list in a segment; blocks are unpacked when they are asked for, once."""

    def __init__(self, head: bytes, body: bytes):
        self.head, self.body = np.frombuffer(head, HEAD), np.frombuffer(body, np.uint8)
        self.first, self.last, self.most = (self.head[c].astype(np.int64) for c in ("first", "last", "most"))
        self.start = np.concatenate([[0], np.cumsum(self.head["n"], dtype=np.int64)])
        self.open = np.zeros(len(self.head), bool)
        self.docs = self.tfs = self.stretches = None

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        if self.docs is None:
            self.docs, self.tfs = np.zeros(self.start[-1], np.int64), np.zeros(self.start[-1], np.int64)
        self.open[blocks] = True
        h = self.head[blocks]
        n, gw, tw = (h[c].astype(np.int64) for c in ("n", "gap", "tf"))
        length = (n * (gw + tw) + 7) // 8
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        from_ = np.repeat(h["at"].astype(np.int64), length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        bits = np.unpackbits(self.body[from_], bitorder="little")
        base = np.repeat((np.cumsum(length) - length) * 8, n)
        out = []
        for own, skip in ((gw, 0 * n), (tw, n * gw)):
            w, value = np.repeat(own, n), np.zeros(len(place), np.int64)
            at = base + np.repeat(skip, n) + place * w
            for b in range(int(own.max(initial=0))):
                k = np.flatnonzero(w > b)
                value[k] |= bits[at[k] + b].astype(np.int64) << b
            out.append(value)
        run = np.cumsum(out[0])
        begin = np.cumsum(n) - n
        to = np.repeat(self.start[blocks], n) + place
        self.docs[to] = run - np.repeat(run[begin], n) + np.repeat(h["first"].astype(np.int64), n)
        self.tfs[to] = out[1] + 1

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that may hold each document, or the number of blocks if none may."""
        b = np.searchsorted(self.last, docs)
        inside = b < len(self.last)
        inside[inside] = self.first[b[inside]] <= docs[inside]
        return np.where(inside, b, len(self.last))

    def by_stretch(self, width: int, n: int) -> np.ndarray:
        """The largest impact of blocks that reach into each of n stretches of `width` documents."""
        if self.stretches is None:
            lo = np.arange(n) * width
            i, j = np.searchsorted(self.last, lo), np.searchsorted(self.first, lo + width)
            out = np.maximum.reduceat(np.append(self.most, 0), np.stack([i, np.maximum(j, i)], axis=1).ravel())[::2]
            self.stretches = np.where(i < j, out, 0)
        return self.stretches

    def scores(self, docs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Impact of the term in each document; blocks that may hold one are unpacked."""
        b = self.block_of(docs)
        maybe = np.flatnonzero(b < len(self.last))
        out = np.zeros(len(docs), np.int64)
        if len(maybe):
            need = np.unique(b[maybe])
            self.unpack(need)
            n = np.diff(self.start)[need]
            at = np.repeat(self.start[need] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = self.docs[at]
            k = np.searchsorted(own, docs[maybe])
            k[k == len(own)] = 0
            hit = own[k] == docs[maybe]
            who = maybe[hit]
            out[who] = impact(self.tfs[at[k[hit]]], m[docs[who]])
        return out


def _of_blocks(p: Postings, blocks: np.ndarray) -> np.ndarray:
    """The documents of some blocks of a list."""
    p.unpack(blocks)
    n = np.diff(p.start)[blocks]
    return p.docs[np.repeat(p.start[blocks] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(blocks) else np.zeros(0, np.int64)


def best(lists: list[tuple[int, Postings]], m: np.ndarray, ids: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): the k best of a segment by score, then id, of those with a score above 0 and from `threshold` on."""
    none = np.zeros(0, np.int64)
    got, scores, threshold = none, none, max(threshold, 1)
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * int(x[1].most.max()))
    sums = np.cumsum([w * int(p.most.max()) for w, p in lists]) if lists else none
    if not lists or sums[-1] < threshold:
        return none, none
    width = -(-len(m) // STRETCHES)
    beside = np.array([w for w, _ in lists]) @ np.stack([p.by_stretch(width, STRETCHES) for _, p in lists])

    def score(docs):
        """Scores documents from the highest bound down, as long as bounds reach the threshold."""
        nonlocal got, scores, threshold
        docs = docs[beside[docs // width] >= threshold]
        bound = np.zeros(len(docs), np.int64)
        for w, p in lists:
            bound += w * np.append(p.most, 0)[p.block_of(docs)]
        order = np.argsort(-bound, kind="stable")
        docs, bound = docs[order], bound[order]
        at, step = 0, 4 * k
        while at < len(docs) and bound[at] >= threshold:
            end = min(at + step, int(np.searchsorted(-bound, -threshold, side="right")))
            part = docs[at:end]
            found = np.zeros(len(part), np.int64)
            for w, p in lists:
                found += w * p.scores(part, m)
            got, scores = np.concatenate([got, part]), np.concatenate([scores, found])
            keep = np.lexsort((ids[got], -scores))
            keep = keep[scores[keep] >= threshold][:k]
            got, scores = got[keep], scores[keep]
            if len(got) == k:
                threshold = max(threshold, int(scores[-1]))
            at, step = end, step * 4

    # The best block of the lists that can add most gives a threshold to begin with.
    first = np.unique(np.concatenate([_of_blocks(p, np.array([int(p.most.argmax())])) for _, p in lists[-SEEDS:]]))
    score(first)
    found = []
    for _, p in lists[int(np.searchsorted(sums, threshold)) :]:  # those before don't reach the threshold together
        reach = np.maximum.reduceat(np.append(beside, 0), np.stack([p.first // width, p.last // width + 1], axis=1).ravel())[::2]
        found.append(_of_blocks(p, np.flatnonzero(reach >= threshold)))
    if found:
        score(np.setdiff1d(np.concatenate(found), first))
    return got, scores


def build(docs: DataFrame) -> DataFrame:
    """The index of (doc_id, text), stored: a row for each segment and term, and one without term for a segment's documents.

    Every document with a term is indexed, whatever its id; rows that share an id are documents of their own. Null and empty
    texts have no terms. Further columns are ignored.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batches):
        for batch in batches:
            n = np.concatenate([terms(p["text"])[1] for p in texthash.slices(batch, "text")] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["n", "total"])

    sizes = read.mapInArrow(count, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    n_docs, total = sizes["n"], max(1, sizes["total"])

    def segment(number, ids, valid, hashes, counts):
        ids, valid, counts = np.concatenate(ids), np.concatenate(valid), np.concatenate(counts)
        h = np.concatenate(hashes)
        m = 75 + (25 * counts * n_docs) // total
        order = np.argsort(h, kind="stable")
        h, d = h[order], np.repeat(np.arange(len(counts)), counts)[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        at = np.flatnonzero(new)
        tf, d, h = np.diff(np.append(at, len(h))), d[at], h[at]
        lists = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        head, body, first_block, bytes_at = packed(d, tf, impact(tf, m[d]), lists)
        cut = lambda offsets, data: pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        rows = [pa.array(np.full(len(lists), number)), pa.array(h[lists].view(np.int64)), pa.array(np.diff(np.append(lists, len(d)))), cut(first_block * HEAD.itemsize, head.tobytes()), cut(bytes_at[first_block], body)]
        names = ["segment", "term", "n", "head", "body"]
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.int64()), pa.array([len(ids)]), pa.array([m.tobytes()], pa.binary()), pa.array([ids.tobytes() + valid.tobytes()], pa.binary())], names)
        whole = pa.RecordBatch.from_arrays(rows, names)
        for k in range(0, len(lists), 1 << 16):
            yield whole.slice(k, 1 << 16)

    def index(batches):
        number = TaskContext.get().partitionId() << 32
        held, size, n = ([], [], [], []), 0, 0
        for batch in batches:
            for part in texthash.slices(batch, "text"):
                h, counts = terms(part["text"])
                some = np.flatnonzero(counts > 0)
                if not len(some):
                    continue
                ids = part["doc_id"].take(pa.array(some))
                for column, x in zip(held, (pc.fill_null(ids, 0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), h, counts[some]), strict=True):
                    column.append(x)
                size, n = size + int(pc.sum(pc.binary_length(part["text"])).as_py()), n + len(some)
                if size >= SEGMENT_BYTES or n >= SEGMENT_DOCS:
                    yield from segment(number, *held)
                    held, size, n, number = ([], [], [], []), 0, 0, number + 1
        if n:
            yield from segment(number, *held)

    out = stored(read.mapInArrow(index, INDEX))
    return out.withColumn("n_docs", F.lit(n_docs))


def _queries(items: DataFrame, key: str) -> DataFrame:
    """(query, key, term, times): the terms of each row of items, which is a query of its own."""
    numbered = stored(items.select(F.col(key).alias("key"), "text").withColumn("query", F.monotonically_increasing_id()))

    def split(batches):
        for batch in batches:
            for part in texthash.slices(batch, "text"):
                h, counts = terms(part["text"])
                at = np.repeat(np.arange(len(counts)), counts)
                yield pa.RecordBatch.from_arrays([part["query"].take(pa.array(at)), part["key"].take(pa.array(at)), pa.array(h.view(np.int64))], ["query", "key", "term"])

    kind = dict(numbered.dtypes)["key"]
    return numbered.mapInArrow(split, f"query long, key {kind}, term long").groupBy("query", "key", "term").agg(F.count("*").alias("times"))


def _thresholds(lists: DataFrame, weighed: DataFrame, k: int) -> DataFrame:
    """(query, threshold): k documents or more score as much, since a term has so large an impact in k blocks."""

    def largest(batches):
        for batch in batches:
            term, most = [], []
            for t, h in zip(batch["term"].to_pylist(), batch["head"], strict=True):
                x = np.sort(np.frombuffer(h.as_buffer(), HEAD)["most"])[::-1][:k]
                term.append(np.full(len(x), t))
                most.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(term or [[]]).astype(np.int64)), pa.array(np.concatenate(most or [[]]).astype(np.int64))], ["term", "most"])

    x = lists.select("term", "head").mapInArrow(largest, "term long, most long")
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("most")))).where(F.col("_k") <= k)
    kth = x.where(F.col("_k") == k).select("term", "most")
    return weighed.join(kth, "term").groupBy("query").agg(F.max(F.col("weight") * F.col("most")).alias("threshold"))


def top(index: DataFrame, items: DataFrame, key: str, k: int = 20) -> DataFrame:
    """(key, rank, doc_id, score): the k best documents for each row of `items` (key, text).

    Only scores above 0 count; equal scores go by doc_id, null last. Items without terms, and those whose terms no document
    holds, give no rows; rows that share a key are ranked apart. Items go to the tasks in lots of about QUERY_TERMS terms, one
    search after the other; within a lot, tasks unpack lists of its terms only.
    """
    spark = index.sparkSession
    n_docs = index.select("n_docs").first()
    with scratch(spark):
        asked = stored(_queries(items, key))
        lots = -(-asked.count() // QUERY_TERMS) if n_docs else 0
        found = None
        for lot in range(lots):
            own = asked.where(F.pmod(F.xxhash64("query"), F.lit(lots)) == lot)
            part = kept(_searched(index, own, n_docs[0], k))
            found = part if found is None else found.unionByName(part)
        if found is None:
            kind = dict(asked.dtypes)["key"]
            found = spark.createDataFrame([], f"query long, key {kind}, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("key").alias(key), "rank", "doc_id", "score")


def _searched(index: DataFrame, asked: DataFrame, n_docs: int, k: int) -> DataFrame:
    """(query, key, doc_id, score): what each segment has to say for a lot of queries; some rows more than the k best."""
    spark = index.sparkSession
    wanted = F.broadcast(asked.select("term").distinct())  # at most QUERY_TERMS and one item's own terms
    lists = index.join(wanted, "term", "left_semi")
    df = lists.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighed = stored(asked.join(df, "term").select("query", "term", (weight * F.col("times")).alias("weight")))
    got = weighed.join(_thresholds(lists, weighed, k), "query", "left").orderBy("query").toArrow()
    query, cut = np.unique(got["query"].to_numpy(), return_index=True)
    plan = spark.sparkContext.broadcast((query, np.append(cut, len(got)), got["term"].to_numpy(), got["weight"].to_numpy(), pc.fill_null(got["threshold"], 0).to_numpy()))

    def search(segment: pa.Table) -> pa.Table:
        query, cut, term, weight, threshold = plan.value
        rows = segment.select(["term", "head", "body"]).to_pydict()
        at = rows["term"].index(None)
        m, data = np.frombuffer(rows["head"][at], np.int64), rows["body"][at]
        ids, valid = np.frombuffer(data, np.int64, len(m)), np.frombuffer(data, bool, len(m), 8 * len(m))
        # Null ids come last among equal scores.
        rank = np.where(valid, ids, np.iinfo(np.int64).max)
        lists = {t: Postings(h, b) for t, h, b in zip(rows["term"], rows["head"], rows["body"], strict=True) if t is not None}
        out: list[list] = [[], [], []]
        for j, q in enumerate(query):
            span = slice(cut[j], cut[j + 1])
            own = [(w, lists[t]) for t, w in zip(term[span].tolist(), weight[span].tolist(), strict=True) if t in lists]
            docs, scores = best(own, m, rank, k, int(threshold[cut[j]]))
            out[0] += [q] * len(docs)
            out[1] += [ids[d] if valid[d] else None for d in docs]
            out[2] += scores.tolist()
        return pa.table({"query": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    used = lists.unionByName(index.where("term IS NULL").select(*lists.columns))
    hits = used.select("segment", "term", "head", "body").repartition(tasks(spark), "segment").groupBy("segment").applyInArrow(search, "query long, doc_id long, score long")
    return hits.join(F.broadcast(asked.select("query", "key").distinct()), "query")
