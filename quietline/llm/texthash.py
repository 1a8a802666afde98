"""Words, shingles and their 64-bit hashes for whole Arrow batches of texts, without a Python step a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of a well-known public hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 20)
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, x, np.uint64)])) for x in (MULTIPLIER, inverse)]
    return _powers[0], _powers[1]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """Parts of a batch with about `most` bytes of text each; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < batch.num_rows:
        j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most)))
        yield batch.slice(k, j - k)
        k = j


def _marks(texts: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where words start, where they end, where texts end and begin)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(bounds[-1] - bounds[0])
    if not size:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    full = ~separators[raw]
    cut = np.zeros(size + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(full & (cut[:-1] | np.concatenate([[True], ~full[:-1]])))
    ends = np.flatnonzero(full & (cut[1:] | np.concatenate([~full[1:], [True]]))) + 1
    return raw, starts, ends, bounds


def words(texts: pa.Array, lower: bool = True, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text). Words are runs of bytes that don't separate; null has none."""
    raw, starts, ends, bounds = _marks(texts, separators)
    return _hashes(raw, starts, ends, lower), np.diff(np.searchsorted(starts, bounds))


def words_and_endings(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, hash of its last three bytes, number of words of each text)."""
    raw, starts, ends, bounds = _marks(texts, _SPACE)
    raw = _LOWER[raw] if lower else raw
    tail = np.zeros(len(starts), np.uint64)
    for k in (3, 2, 1):
        at = ends - k
        byte = raw[np.maximum(at, 0)].astype(np.uint64) if len(raw) else tail
        tail = tail * np.uint64(256) + np.where(at >= starts, byte, np.uint64(0))
    return _hashes(raw, starts, ends, False), mix(tail + np.uint64(1)), np.diff(np.searchsorted(starts, bounds))


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    size = len(raw)
    if not size:
        return np.zeros(0, np.uint64)
    power, inverse = _tables(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((_LOWER[raw] if lower else raw).astype(np.uint64) * power[:size] + power[:size], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h ^ mix((ends - starts).astype(np.uint64)))


def shingles(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text: runs of k words; the whole text if it has fewer, but some, words."""
    w, counts = words(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    if len(w) >= k:
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = h * MULTIPLIER + w[j : len(w) - k + 1 + j]
        h = mix(h)
    out = []
    for i, n in enumerate(counts):
        if n >= k:
            out.append(np.unique(h[at[i] : at[i + 1] - k + 1]))
        elif n:
            x = np.array([n], np.uint64)
            for j in range(at[i], at[i + 1]):
                x = mix(x * MULTIPLIER + w[j : j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    """A hash of a set of shingles, as a signed 64-bit number; it doesn't depend on order."""
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0]
    return int(h.astype(np.int64))
