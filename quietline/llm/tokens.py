"""Token ids in a packed binary store.

Store: rows of Parquet, written by Spark's committer, so that a lost or repeated task leaves nothing half done. A row is a block:

    shard long       rank of the range of documents; shards are in document order
    block long       number of the block in its shard
    before long      ids of the shard before this block: the block offset
    n_ids long       ids in the block
    bits int         width of an id: the bits that the largest id of the vocabulary takes
    docs array<long> the document ids, in order
    sizes array<int> ids of each document, so a document is found by a running sum
    payload binary   the ids, `bits` each, lowest bit first, padded to whole bytes

Documents never straddle blocks. Every id has the same width, so id i of a block lies at bit i * bits: one document, or any
range of one, is read without unpacking the rest.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import keep_until_clear, shared_dir, tasks

#: Ids of a block before it is closed; the last document of a block is stored whole.
BLOCK_IDS = 1 << 18

#: Distinct pieces that the library encodes as one text; speed alone depends on it.
PIECES = 1024

#: Texts whose space-led pieces can't be told apart from the library's: odd white space, or a space beside another or a line end.
ODD = r"^ |  | \n|\n | $|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Fixed value: how byte-level vocabularies write the byte of a space.
SPACE_BYTE = "\u0120"

STORE = "shard long, block long, before long, n_ids long, bits int, docs array<long>, sizes array<int>, payload binary"


def width(vocabulary: int) -> int:
    """Bits of an id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    out = []
    for k in range(0, len(ids), 1 << 16):  # a multiple of 8 ids, so the parts join on whole bytes
        out.append(np.packbits((ids[k : k + (1 << 16), None] >> np.arange(bits, dtype="<u4") & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """Ids start to start + n of a payload; only their bytes are touched."""
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8, count=min(len(payload) - first, (start * bits % 8 + n * bits + 7) // 8), offset=first)
    if bits == 16:
        return raw.view("<u2").astype("<u4")
    flat = np.unpackbits(raw, bitorder="little")[start * bits % 8 :][: n * bits].reshape(n, bits)
    return (flat.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


def splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer file is a byte-level BPE that changes no text and begins a new piece at a space between words."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file.get("model") or {}, file.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return model.get("type") == "BPE" and plain and level and not file.get("normalizer") and not file.get("truncation")


class Encoder:
    """Encodes whole texts; equal pieces of a call are encoded once.

    A byte-level BPE splits a text before it merges, and a single space between two other characters always begins a new
    piece there (`splits_at_spaces` reads from the file whether it is one). So a text without double or other unusual spacing is the concatenation of its space-led pieces, and the
    library encodes only the distinct ones, many joined to one text: in its ids, the tokens that begin with a space say
    where each piece begins. Any other text, and one that holds an added token's text (which the library gives that
    token's id), goes to the library whole, and so do all texts with any other tokenizer.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.distinct, self.end_id = Tokenizer.from_file(path), Tokenizer.from_file(path), end_id
        self.split = splits_at_spaces(path)
        self.odd = "|".join([ODD, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.vocabulary = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.spaced = np.zeros(self.vocabulary, bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE_BYTE)]] = True

    @staticmethod
    @functools.cache
    def of(path: str, end_id: int) -> Encoder:
        """One encoder a Python worker, for all its tasks."""
        return Encoder(path, end_id)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each led by a space, one after another, and the number of ids of each."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        ends = np.minimum(np.arange(0, len(words) + PIECES, PIECES), len(words))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words), pa.scalar(" ", words.type))
        coded = (self.distinct.encode_batch_fast([" " + t.as_py()], add_special_tokens=False)[0].ids for t in joined)
        ids = np.concatenate([np.array(i, dtype="<u4") for i in coded])
        return ids, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each with the end id, and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) | (not self.split)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten()
        bounds -= bounds[0]
        first = np.zeros(len(words), bool)
        first[bounds[:-1]] = True
        heads, rest = words.filter(pa.array(first)).dictionary_encode(), words.filter(pa.array(~first)).dictionary_encode()
        codes = np.empty(len(words), np.int32)
        del lists, words  # what isn't read again goes before the ids are laid out
        ids, sizes = self.pieces(rest.dictionary)
        led = self.whole(heads.dictionary.to_pylist())
        codes[~first] = rest.indices.to_numpy()
        codes[first] = len(sizes) + heads.indices.to_numpy()
        del heads, rest, first
        flat, sizes = _gather(np.concatenate([ids, *led]), np.concatenate([sizes, np.array([len(x) for x in led], np.int64)]).astype(np.int32), codes)
        del ids, codes
        at = np.append(0, np.cumsum(sizes))[bounds]
        of_plain = iter(zip(at[:-1], at[1:], strict=True))
        of_odd = iter(self.whole(texts.filter(pa.array(odd)).to_pylist()))
        end = np.array([self.end_id], dtype="<u4")
        each = [next(of_odd) if o else flat[slice(*next(of_plain))] for o in odd]
        return np.concatenate([x for e in each for x in (e, end)] or [end[:0]]), np.array([len(e) + 1 for e in each], np.int64)


def _gather(pool: np.ndarray, size: np.ndarray, codes: np.ndarray, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the pool that the codes name, joined, and the size of each; run k has size[k] ids and follows run k - 1.

    The places of `most` codes are worked out at a time, as they take several times the memory of the ids themselves.
    """
    at = np.cumsum(size) - size
    sizes = size[codes]
    out, done = np.empty(int(sizes.sum()), pool.dtype), 0
    for k in range(0, len(codes), most):
        own = sizes[k : k + most]
        ends = np.cumsum(own)
        take = np.arange(ends[-1]) + np.repeat(at[codes[k : k + most]] - (ends - own), own)
        out[done : done + len(take)] = pool[take]
        done += len(take)
    return out, sizes


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None, block_ids: int = BLOCK_IDS, text: str = "text") -> None:
    """Encode `docs` in ascending doc_id order (null first, ties by a hash of the text) into a store at `path`.

    Null texts are empty and get the end id alone; rows that share a doc_id are documents of their own. Only doc_id and the
    text are read, so other columns may have any names. The order comes from a range partitioning, so shards follow the data.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    ranged = rows.repartitionByRange(shards or 2 * tasks(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id().cast("long"))

    def encode(batches):
        encoder, bits, block, before, held, n = None, 0, 0, 0, [], 0
        for b in itertools.chain.from_iterable(_slices(b) for b in batches):
            encoder = encoder or Encoder.of(tokenizer, end_id)
            bits = width(encoder.vocabulary)
            shard = b["shard"][0].as_py()
            ids, sizes = encoder.encode(b["text"])
            pa.default_memory_pool().release_unused()  # else the worker keeps what the texts' words took
            at = np.concatenate([[0], np.cumsum(sizes)])
            names, k = b["doc_id"].to_pylist(), 0
            while k < len(names):
                # The documents that still fit, and one more if none does.
                room = int(np.searchsorted(at, at[k] + max(block_ids - n, 0), side="right")) - 1
                j = min(max(room, k if held else k + 1), len(names))
                if j > k:
                    held.append((names[k:j], sizes[k:j], ids[at[k] : at[j]]))
                    n += int(at[j] - at[k])
                k = j
                if k < len(names) or n >= block_ids:
                    yield _block(shard, block, before, bits, held)
                    block, before, held, n = block + 1, before + n, [], 0
        if held:
            yield _block(shard, block, before, bits, held)

    ranged.select("shard", "doc_id", "text").mapInArrow(encode, STORE).write.option("compression", "none").parquet(path)


def _slices(batch: pa.RecordBatch, most: int = 6 << 20):
    """Parts of a batch of about `most` bytes of text, so that long texts don't add up."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
    k = 0
    while k < batch.num_rows:
        j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most)))
        yield batch.slice(k, j - k)
        k = j


def _block(shard, block, before, bits, held) -> pa.RecordBatch:
    ids = np.concatenate([h[2] for h in held])
    columns = [[shard], [block], [before], [len(ids)], [bits], [[d for h in held for d in h[0]]], [np.concatenate([h[1] for h in held]).tolist()], [pack(ids, bits)]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in STORE.split(", ")])


def read(spark: SparkSession, path: str, **digests) -> DataFrame:
    """One row a document, from the store alone: doc_id, start, n_tokens, ids_crc32, and `ids` with `ids=True`.

    start is the number of ids of all documents before it: shard totals come from a scan that skips the payloads.
    """
    blocks = spark.read.schema(STORE).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    keep = bool(digests.get("ids"))
    schema = T.StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep)

    def decode(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = {c: b[c][r].as_py() for c in b.schema.names}
                ids, sizes = unpack(x["payload"], x["bits"], x["n_ids"]), np.array(x["sizes"], np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
                columns = [pa.array(x["docs"], pa.int64()), pa.array(x["base"] + x["before"] + at[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array([ids[i:j].astype("<i4") for i, j in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int32()))] * keep
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # One row a shard, and the writer sets how many there are: two for each shuffle partition.
    return blocks.join(F.broadcast(starts), "shard").select("base", "before", "n_ids", "bits", "docs", "sizes", "payload").mapInArrow(decode, schema)


def document(store: DataFrame, doc_id: int) -> DataFrame:
    """The ids of one document by random access: its block alone is read, and of that its own bytes."""
    hit = store.where(F.array_contains("docs", doc_id))

    def one(batches):
        for b in batches:
            for r in range(b.num_rows):
                k, sizes = b["docs"][r].as_py().index(doc_id), b["sizes"][r].as_py()
                ids = unpack(b["payload"][r].as_py(), b["bits"][r].as_py(), sizes[k], sum(sizes[:k]))
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i4")], pa.list_(pa.int32()))], names=["ids"])

    return hit.select("docs", "sizes", "bits", "payload").mapInArrow(one, "ids array<int>")


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    """Write a store to the shared folder and read it back."""
    path = keep_until_clear(shared_dir(docs.sparkSession))
    write(docs, path, tokenizer, end_id, **options)
    return read(docs.sparkSession, path)
