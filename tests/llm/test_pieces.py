"""Joined pieces give the ids that the library gives for whole texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quietline.llm.queries import tokenizer_path
from quietline.llm.tokens import Encoder, _gather

TEXTS = ["", None, " ", "a", " a", "a ", "a b's  c", "it 's\n x", "a\nb c\n\nd", "x y z x y z", "<|endoftext|> a <|endoftext|>", "é ü 日本 語 🙂 🙂", "1 22 333'll 've", "\n a", "a \n b", "Ġ ĠĠ a", "a b c"]


def test_pieces():
    e = Encoder.of(tokenizer_path(), 2)
    for texts in (TEXTS, TEXTS[:3], ["w%d v%d" % (k, k % 7) for k in range(3000)], []):
        ids, sizes = e.encode(pa.array(texts, pa.string()))
        want = [np.append(x, 2) for x in e.whole([t or "" for t in texts])]
        assert ids.tolist() == [i for w in want for i in w.tolist()] and sizes.tolist() == [len(w) for w in want]


def test_gather_holds_little():
    """Laying out ids takes little more memory than the ids themselves, and parts of codes join as they should."""
    r = np.random.default_rng(3)
    size = r.integers(0, 9, 500).astype(np.int32)
    pool, codes = np.arange(size.sum(), dtype="<u4"), r.integers(0, 500, 1 << 20).astype(np.int32)
    tracemalloc.start()
    try:
        ids, sizes = _gather(pool, size, codes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    runs = np.split(pool, np.cumsum(size)[:-1])
    assert (ids == np.concatenate([runs[c] for c in codes])).all() and (sizes == size[codes]).all()
    assert peak < 3 * ids.nbytes
    assert [x.tolist() for x in _gather(pool, size, codes[:0])] == [[], []]
