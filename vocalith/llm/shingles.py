"""Five-word shingle sets as sorted arrays of 64-bit hashes, computed over whole Arrow buffers.

Words are maximal runs of bytes other than space and U+0009..U+000D, with A-Z lower-cased. All of these are
ASCII, so working on UTF-8 bytes equals working on code points. Null and empty texts have empty sets; a text
with fewer words than ``k`` has one shingle, its whole word sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE_WORDS = 5
#: Bytes hashed at a time; bounds the scratch arrays of one call whatever the batch holds.
BLOCK_BYTES = 1 << 20
#: Words of this many bytes are hashed by xxh3 instead of the vectorised polynomial.
LONG_WORD = 256

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = down = np.ones(0, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_BASE_INV, n)
        return cls.up, cls.down


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the documents that ``bounds`` cuts ``data`` into, and the words before each bound."""
    space = _SPACE[data]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    at = bounds[:-1][bounds[:-1] < len(data)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= space[1:]
    at = bounds[1:][(bounds[1:] > 0) & (bounds[1:] <= len(data))] - 1
    last[at] = inside[at]
    ends = np.flatnonzero(last) + 1
    up, down = _Powers.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
        words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        words[i] = xxhash.xxh3_64_intdigest(_LOWER[data[starts[i] : ends[i]]].tobytes(), seed=7)
    return words, np.searchsorted(starts, bounds)


def _shingled(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of one document's word hashes, ascending."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    with np.errstate(over="ignore"):
        total = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            total += words[i : n - size + 1 + i] * _BYTE[i]
        out = mix(total)
    out.sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    return out[keep]


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS):
    """Yields one ascending uint64 array per text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        if offsets[j] - offsets[i] > 2 * BLOCK_BYTES:  # one very long text
            yield _shingled(_long(data[offsets[i] : offsets[j]]), k)
        else:
            words, cut = _word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for a, b in zip(cut[:-1], cut[1:]):
                yield _shingled(words[a:b], k)
        i = j


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text block by block, cut at white space."""
    out, i = [], 0
    while i < len(data):
        j = min(len(data), i + BLOCK_BYTES)
        while j < len(data) and not _SPACE[data[j]]:
            gaps = np.flatnonzero(_SPACE[data[j : j + BLOCK_BYTES]])
            j = j + int(gaps[0]) if len(gaps) else min(len(data), j + BLOCK_BYTES)
        out.append(_word_hashes(data[i:j], np.array([0, j - i]))[0])
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
