"""Document scores by masked pseudo-likelihood.

A network sees a window of words on both sides of a masked one and predicts it: embeddings of the `SIDE` words to the left and
right, each place with its own table, are summed, pass a nonlinearity and give a distribution over the vocabulary, in two steps:
over classes of ids, then over the ids of the class. The score of a document is the sum over its words of the log-probability of
each, given both sides.

Vocabulary: the most frequent words of the whole corpus have an id each; the others share hashed ids by their last letters.
Such a word has the log-probability of its hashed id plus that of the word given the id: its share of the id's count in the
whole corpus. So every word is told from every other, and the counts grow with the corpus: those of the `TABLE` most frequent
words at most go to the tasks, the rest stays a distributed table that is joined to the texts by word.

Training: texts, as ids, are dealt into shards by a hash of their ids. Shards, and the steps of each, grow with the corpus and
don't follow the input's partitions. It starts from the corpus's word frequencies. In each round a shard masks the words whose
turn it is (by a hash of the text and the place) and takes gradient steps in numpy; its parameters, weighted by its words, are
summed over the cluster as whole numbers, so the order of the sums doesn't matter. In `ROUNDS` averages every word is a target once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, scratch, stored, tasks
from .texthash import mix, slices, words_and_endings

#: Words with an id of their own, hashed ids, ids of a class, width of the layer, words seen on a side.
KNOWN, HASHED, CLASS, WIDTH, SIDE = 3072, 1024, 64, 24, 2
VOCABULARY = KNOWN + HASHED
CLASSES = VOCABULARY // CLASS
#: The id of what lies beyond the text's ends; it is never predicted.
EDGE = VOCABULARY
#: Averages, which mask each word once together, words of a gradient step, and its rate.
ROUNDS, STEP, RATE = 3, 4096, 0.25
#: Words of a corpus that is one shard; shards grow with the square root of the words, until one has as many as MOST.
SHARD, MOST = 500_000, 32_000_000
#: Words whose counts go to the tasks.
TABLE = 1 << 20
#: Parameters of a block as they are summed, and the fraction bits of a sum.
BLOCK, FRACTION = 4096, 40


@dataclass
class Network:
    """e: [place, id, width]; b: [width]; k, kb: classes [width, class], [class]; o, ob: ids [class, width, id of it], [class, id of it]."""

    e: np.ndarray
    b: np.ndarray
    k: np.ndarray
    kb: np.ndarray
    o: np.ndarray
    ob: np.ndarray

    @staticmethod
    def start(counts: np.ndarray | None = None) -> Network:
        """Random contexts, and output that gives each id its frequency (all ids are equal without counts)."""
        r = np.random.default_rng(11)
        n = (np.ones(VOCABULARY) if counts is None else counts + 0.5).reshape(CLASSES, CLASS)
        whole = n.sum(axis=1)
        weights = [r.normal(0, 0.1, shape).astype("f4") for shape in ((2 * SIDE, VOCABULARY + 1, WIDTH), (WIDTH, CLASSES), (CLASSES, WIDTH, CLASS))]
        biases = np.log(whole / whole.sum()).astype("f4"), np.log(n / whole[:, None]).astype("f4")
        return Network(weights[0], np.zeros(WIDTH, "f4"), 0.1 * weights[1], biases[0], 0.1 * weights[2], biases[1])

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.e, self.b, self.k, self.kb, self.o, self.ob]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        out, at = [], 0
        for x in Network.start().parts:
            out.append(flat[at : at + x.size].reshape(x.shape).astype("f4"))
            at += x.size
        return Network(*out)

    @property
    def small(self) -> bool:
        """Whether no logit can be too large for exp: the hidden layer lies between -1 and 1."""
        return max(float((np.abs(x).sum(axis=-2) + np.abs(b)).max()) for x, b in ((self.k, self.kb), (self.o, self.ob))) < 60

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """k and o, each with its bias as one row more: what a last column of ones in the hidden layer meets."""
        return np.concatenate([self.k, self.kb[None]]), np.concatenate([self.o, self.ob[:, None]], axis=1)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """The hidden layer, and a column of ones."""
        total = np.take(self.e[0], context[:, 0], axis=0)
        for place in range(1, 2 * SIDE):
            total += np.take(self.e[place], context[:, place], axis=0)
        total += self.b
        out = np.ones((len(context), WIDTH + 1), "f4")
        np.tanh(total, out=out[:, :WIDTH])
        return out

    def logs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target."""
        k, o = self.joined()
        group, small = target // CLASS, self.small
        order, edges = _by_class(group)
        h = self.hidden(context[order])
        logs = _log_of(h @ k, group[order], small)
        logs += _log_of(_within(h, o, edges), (target % CLASS)[order], small)
        out = np.empty(len(target))
        out[order] = logs
        return out


def _by_class(group: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """(places in order of class, the run of each class)."""
    order = np.argsort(group.astype("u2"), kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=CLASSES))])
    return order, [slice(i, j) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _within(h: np.ndarray, o: np.ndarray, edges: list[slice]) -> np.ndarray:
    """Logits of the ids of each row's class, for rows in order of class."""
    z = np.empty((len(h), CLASS), "f4")
    for c, s in enumerate(edges):
        if s.start < s.stop:
            np.matmul(h[s], o[c], out=z[s])
    return z


#: A product with it is the sum of a row of logits, and faster.
_ONES = np.ones(CLASS, "f4")


def _log_of(z: np.ndarray, own: np.ndarray, small: bool) -> np.ndarray:
    """Logarithm of the softmax of each row at its own column; z is used up."""
    if not small:
        z -= z.max(axis=1, keepdims=True)
    at = z[np.arange(len(own)), own]
    return at - np.log(np.exp(z, out=z) @ _ONES)


def _error(z: np.ndarray, own: np.ndarray, n: np.float32, small: bool) -> np.ndarray:
    """Gradient of the mean cross-entropy by the logits z, in their place."""
    if not small:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (n / (z @ _ONES))[:, None]
    z[np.arange(len(own)), own] -= n
    return z


class Trainer:
    """Gradient steps on the cross-entropy, each parameter's rate by the sum of its squared gradients."""

    def __init__(self, net: Network):
        # Output weights and biases are held as one, and the network has views of them.
        self.k, self.o = net.joined()
        self.e = np.concatenate(list(net.e))
        self.net = Network(self.e.reshape(net.e.shape), net.b.copy(), self.k[:-1], self.k[-1], self.o[:, :-1], self.o[:, -1])
        self.seen = [np.full(n, 1e-3, "f4") for n in (len(self.e), net.b.shape, self.k.shape, self.o.shape)]
        self.grad = np.zeros_like(self.o)

    def _move(self, x: np.ndarray, seen: np.ndarray, g: np.ndarray) -> None:
        """Moves x by the gradient g, which is used up."""
        seen += g * g
        g /= np.sqrt(seen)
        g *= RATE
        x -= g

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n, group, grad = self.net, np.float32(1 / len(target)), target // CLASS, self.grad
        order, edges = _by_class(group)
        context, small = context[order], net.small
        h = net.hidden(context)
        z = _error(h @ self.k, group[order], n, small)
        y = _error(_within(h, self.o, edges), (target % CLASS)[order], n, small)
        back, own = z @ net.k.T, np.empty((len(target), WIDTH), "f4")
        for c, s in enumerate(edges):
            if s.start < s.stop:
                np.matmul(y[s], net.o[c].T, out=own[s])
                np.matmul(h[s].T, y[s], out=grad[c])
            else:
                grad[c] = 0
        back += own
        self._move(self.k, self.seen[2], h.T @ z)
        self._move(self.o, self.seen[3], grad)
        h = h[:, :-1]
        back *= 1 - h * h
        self._move(net.b, self.seen[1], back.sum(axis=0))
        # Rows of e: those of all places at once, each place's after the others'.
        ids = (context + np.arange(2 * SIDE, dtype=np.int32) * (VOCABULARY + 1)).astype("u2").ravel()
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        g, own = np.add.reduceat(np.take(back, by // (2 * SIDE), axis=0), heads), ids[heads].astype(np.int64)
        # One rate for the row of an id.
        seen = self.seen[0][own] + (g * g) @ np.full(WIDTH, 1 / WIDTH, "f4")
        self.seen[0][own] = seen
        g *= (RATE / np.sqrt(seen))[:, None]
        self.e[own] -= g


class Places:
    """Places of hashes in an ascending array of different ones, found by their first bits: few begin alike."""

    def __init__(self, ordered: np.ndarray):
        self.ordered = ordered
        bits = max(1, min(21, len(ordered).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(ordered, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.most = int(np.diff(np.append(self.starts, len(ordered))).max())

    def of(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash; -1 for those that aren't there."""
        out = np.full(len(h), -1, np.int32)
        if len(self.ordered):
            at = self.starts[(h >> self.shift).view(np.int64)]
            left = np.arange(len(h))
            for _ in range(self.most):
                here = self.ordered[np.minimum(at, len(self.ordered) - 1)]
                out[left[here == h]] = at[here == h]
                on = here < h
                h, at, left = h[on], at[on] + 1, left[on]
        return out


class Vocabulary:
    """Ids of words by their hashes, those of rare words by the hash of their last letters."""

    def __init__(self, known: np.ndarray):
        self.order = np.argsort(known)
        self.places = Places(known[self.order])

    def ids(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        hashed = (KNOWN + (ending % np.uint64(HASHED))).astype(np.int32)
        at = self.places.of(h)
        return np.where(at >= 0, self.order[at], hashed).astype(np.int32) if len(self.order) else hashed


def contexts(ids: np.ndarray, counts: np.ndarray, pick: np.ndarray | None = None) -> np.ndarray:
    """[word, place]: the ids to the left and right of every word, or of those picked; EDGE beyond its text."""
    shift = np.repeat(np.arange(len(counts)), counts) * SIDE + SIDE
    padded = np.full(len(ids) + (len(counts) + 1) * SIDE, EDGE, np.int32)
    at = np.arange(len(ids)) + shift
    padded[at] = ids
    at = at if pick is None else at[pick]
    return np.stack([padded[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def turns(key: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which each word is a target: by its text's key and its place in the text."""
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(key, counts) ^ mix(place.astype(np.uint64))) % np.uint64(max(1, rounds))


def _hashed(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, ...]:
    """`words_and_endings` of a batch, in parts that stay in a processor's cache."""
    parts = [words_and_endings(part[text]) for part in slices(batch, text, 1 << 18)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, ending, n): how often each word occurs in all documents, by its hash, and its hashed id from 0."""

    def count(batches):
        for b in batches:
            for part in slices(b, text, 8 << 20):
                every, ending, _ = _hashed(part, text)
                h, at, n = np.unique(every, return_index=True, return_counts=True)
                own = (ending[at] % np.uint64(HASHED)).astype(np.int32)
                columns = [pa.array(h.view(np.int64)), pa.array(own), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "ending", "n"])

    rows = docs.select(text).mapInArrow(count, "h long, ending int, n long")
    return rows.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = KNOWN) -> list[tuple[int, int]]:
    """(hash, count) of the most frequent words; ties go to the smaller hash."""
    return [(r.h, r.n) for r in counts.orderBy(F.desc("n"), "h").limit(most).collect()]


@dataclass
class Model:
    """What scoring needs: the network, the known words, the counts of hashed ids, and those of the words in the table.

    `border`: words that occur as often, or more often, are all in the table. `counts` (h, n) has the others.
    """

    flat: np.ndarray
    known: np.ndarray
    buckets: np.ndarray
    table: np.ndarray
    times: np.ndarray
    border: int
    counts: DataFrame | None = None


def _table(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Words that occur `border` times or more, with the smallest border of a series for which they are at most `most`."""
    borders = sorted({int(2 ** (k / 2)) for k in range(1, 120)} | {1})
    sums = counts.agg(*(F.count(F.when(F.col("n") >= b, 1)).alias(str(b)) for b in borders)).first()
    border = next((b for b in borders if sums[str(b)] <= most), borders[-1])
    found = counts.where(F.col("n") >= border).select("h", "n").toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype("f8"), border


def coded(docs: DataFrame, known: np.ndarray, text: str = "text") -> DataFrame:
    """(key, ids) for each text with words: the ids of its words, 16 bits each, and a hash of them."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def code(batches):
        vocabulary = Vocabulary(shared.value)
        for b in batches:
            for part in slices(b, text):
                h, ending, counts = _hashed(part, text)
                ids = vocabulary.ids(h, ending).astype("<u2")
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["ids"])

    return docs.select(text).mapInArrow(code, "ids binary").select(F.xxhash64("ids").alias("key"), "ids")


def _average(sent: DataFrame, size: int, n: int) -> np.ndarray:
    """The parameters from rows (block, x): whole numbers to be summed, which are streamed; a task holds the sums of its blocks."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b["block"].to_pylist(), b["x"].to_pylist(), strict=True):
                x = np.frombuffer(raw, "<i8")
                sums[block] = sums[block] + x if block in sums else x
        if sums:
            columns = [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "x"])

    # Sums of a part of the shards first, so that no task reads all of a block.
    part = sent.repartition(n, "block", "lot").mapInArrow(add, "block int, x binary")
    rows = part.repartition(min(n, -(-size // BLOCK)), "block").mapInArrow(add, "block int, x binary").collect()
    return np.concatenate([np.frombuffer(r.x, "<i8") for r in sorted(rows, key=lambda r: r.block)]) / 2.0**FRACTION


def trained(docs: DataFrame, known: np.ndarray, counts: np.ndarray, total: int, rounds: int = ROUNDS, text: str = "text") -> np.ndarray:
    """The network's parameters after `rounds` averages over all documents, which have `total` words; `counts` by id."""
    spark = docs.sparkSession
    flat = Network.start(counts).flat()
    if not total:
        return flat
    shards = max(math.ceil(math.sqrt(total / SHARD)), math.ceil(total / MOST))
    dealt = stored(coded(docs, known, text))
    dealt = dealt.repartitionById(shards, F.pmod("key", F.lit(shards)).cast("int")).sortWithinPartitions("key", "ids")
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(flat)

        def learn(batches, shared=shared, turn=turn):
            trainer, seen, lot = Trainer(Network.of(shared.value)), 0, None
            held, waiting = [], 0

            def step(last=False):
                nonlocal held, waiting
                context, target = (np.concatenate(x) for x in zip(*held, strict=True))
                end = len(target) if last else len(target) // STEP * STEP
                for k in range(0, end, STEP):
                    trainer.learn(context[k : min(k + STEP, end)], target[k : min(k + STEP, end)])
                held, waiting = [(context[end:], target[end:])], len(target) - end

            for b in batches:
                key = b["key"].to_numpy()
                lot = int(key[0]) % (1 << 16) if lot is None and len(key) else lot
                raw = b["ids"].to_pylist()
                for i in range(0, len(raw), 256):
                    sizes = np.array([len(r) // 2 for r in raw[i : i + 256]], np.int64)
                    ids = np.frombuffer(b"".join(raw[i : i + 256]), "<u2").astype(np.int32)
                    pick = np.flatnonzero(turns(key[i : i + 256].view(np.uint64), sizes, rounds) == turn)
                    held.append((contexts(ids, sizes, pick), ids[pick]))
                    seen, waiting = seen + len(ids), waiting + len(pick)
                    if waiting >= STEP:
                        step()
            if seen:
                if waiting:
                    step(last=True)
                # Weighted by the shard's part of all words; whole numbers, so that sums don't depend on their order.
                x = np.rint(trainer.net.flat().astype("f8") * (2.0**FRACTION * seen / total)).astype("<i8")
                cuts = range(0, len(x), BLOCK)
                columns = [pa.array(range(len(cuts)), pa.int32()), pa.array([lot % 64] * len(cuts), pa.int32()), pa.array([x[k : k + BLOCK].tobytes() for k in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "lot", "x"])

        sent = dealt.mapInArrow(learn, "block int, lot int, x binary")
        flat = _average(sent, len(flat), tasks(spark)).astype("f4")
    return flat


def fitted(docs: DataFrame, rounds: int = ROUNDS, text: str = "text", table: int = TABLE) -> Model:
    """The model of a corpus. Its counts stay in the shared folder for as long as the model's scope."""
    with scratch(docs.sparkSession):
        counts = kept(counted(docs, text))
        total = counts.agg(F.sum("n")).first()[0] or 0
        top = frequent(counts)
        known = np.array([h for h, _ in top], np.int64).view(np.uint64)
        rare = counts.where(~F.col("h").isin([h for h, _ in top])) if top else counts
        buckets = np.zeros(HASHED)
        for r in rare.groupBy("ending").agg(F.sum("n").alias("n")).collect():  # at most HASHED rows
            buckets[r.ending] = r.n
        by_id = np.concatenate([[n for _, n in top], np.zeros(KNOWN - len(top)), buckets])
        flat = trained(docs, known, by_id, total, rounds, text)
        words, times, border = _table(counts, table)
    return Model(flat, known, buckets, words, times, border, counts)


def scored(docs: DataFrame, rounds: int = ROUNDS, text: str = "text", model: Model | None = None) -> DataFrame:
    """`docs` without the text, with n_words long, log_likelihood double (summed over all words) and mean_log double.

    The model is that of `docs`, unless one is given; a word that it hasn't seen counts as seen once. Texts without words, and
    null ones, have 0 words, 0.0 and a null mean. Columns with the names of results give way; others may have any names.
    """
    spark = docs.sparkSession
    model = model or fitted(docs, rounds, text)
    counts, border = model.counts, model.border
    known, flat, buckets, table, times = model.known, model.flat, model.buckets, model.table, model.times
    shared = spark.sparkContext.broadcast((flat, known, buckets, table, times))
    new = ("n_words", "log_likelihood", "mean_log")
    rest = [c for c in docs.columns if c not in (*new, text)]
    whole = F.struct(*(F.col(c) for c in rest)) if rest else F.lit(None).cast("int")
    rows = docs.select(whole.alias("doc"), F.col(text).cast("string").alias("text"))
    shaped = rows.select("doc", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<h:long,c:int>>").alias("more"))

    def apply(batches):
        flat, known, buckets, table, times = shared.value
        net, vocabulary, listed = Network.of(flat), Vocabulary(known), Places(table)
        whole = np.log(np.maximum(buckets, 1))
        for b in batches:
            for part in slices(b, "text"):
                h, ending, counts = _hashed(part, "text")
                ids = vocabulary.ids(h, ending)
                context = contexts(ids, counts)
                lots = [net.logs(context[k : k + 16384], ids[k : k + 16384]) for k in range(0, len(ids), 16384)]
                logs = np.concatenate(lots or [np.zeros(0)])
                # Words without an id of their own: their count over that of the hashed id.
                rare = np.flatnonzero(ids >= KNOWN)
                at = listed.of(h[rare])
                logs[rare] -= whole[ids[rare] - KNOWN]
                logs[rare[at >= 0]] += np.log(times[at[at >= 0]])
                # Those that aren't in the table either, each once a text, with how often it is there.
                rare = rare[at < 0]
                of = np.repeat(np.arange(len(counts)), counts)[rare]
                order = np.lexsort((h[rare], of))
                own, of = h[rare][order], of[order]
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])])[: len(own)])
                often = np.diff(np.append(new, len(own))).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(own[new].view(np.int64)), pa.array(often)], names=["h", "c"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new], np.arange(len(counts) + 1)), pa.int32()), each)
                ends = np.cumsum(counts)
                sums = np.array([x.sum() for x in np.split(logs, ends[:-1])]) if len(ends) else np.zeros(0)
                columns = [part["doc"], pa.array(counts.astype(np.int64)), pa.array(sums), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "sum", "more"])

    if border > 1 and counts is not None:
        # Stored, so that a row's number is the same for its words and itself.
        rows = stored(rows.mapInArrow(apply, shaped.schema).withColumn("row", F.monotonically_increasing_id()))
        each = rows.where(F.size("more") > 0).select("row", F.explode("more").alias("m")).select("row", "m.h", "m.c")
        seen = counts.where((F.col("n") < border) & (F.col("n") > 1)).select("h", F.log("n").alias("log"))
        more = each.join(seen, "h").groupBy("row").agg(F.sum(F.col("c") * F.col("log")).alias("log"))
        rows = rows.join(more, "row", "left")
        every = F.col("sum") + F.coalesce("log", F.lit(0.0))
    else:
        rows, every = rows.mapInArrow(apply, shaped.schema), F.col("sum")
    mean = F.when(F.col("n_words") > 0, every / F.col("n_words"))
    own = [F.col("doc")[c].alias(c) for c in rest]
    return rows.select(*own, "n_words", every.alias("log_likelihood"), mean.alias("mean_log"))
