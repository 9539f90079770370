"""Vectorised word and shingle hashing over Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Words are
hashed to 64 bits by a polynomial over random byte values, so a batch costs a few numpy passes and
no Python loop over words. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE = _VALUE[_FOLD]
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_SEGMENT = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _U(pow(base, done, 2**64))
        done += more
    return out


_up, _down = _powers(_BASE, _SEGMENT + 1), _powers(_BACK, _SEGMENT + 1)


def parts(batch: pa.RecordBatch, column: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text (one row at least), to bound what is unpacked at a time."""
    if not batch.num_rows:
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    cuts = np.flatnonzero(np.diff((upto - 1) // size)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, and where each text starts and ends (a null is empty)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of the texts, and the number of words before each text."""
    global _up, _down
    if not len(data):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(at), np.int64)
    space = SPACE[data]
    first, last = np.empty(len(data), bool), np.empty(len(data), bool)
    first[0], first[1:] = True, space[:-1]
    last[-1], last[:-1] = True, space[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = True
    last[edges - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + _SEGMENT, "right")))
        a, b = int(starts[k]), int(ends[stop - 1])
        if b - a >= len(_up):
            up, down = _powers(_BASE, b - a + 1), _powers(_BACK, b - a + 1)
        else:
            up, down = _up, _down
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[data[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[k:stop] - a, ends[k:stop] - a
        hashes[k:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        k = stop
    return hashes, starts, ends, np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; of a text with fewer words, one of them all."""
    hashes, _, _, upto = words(*text_buffer(texts))
    total = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for j in range(n):
        total += mix(hashes[j : j + len(total)] + _U(j + 1)) * _U(2 * j + 3)
    total = mix(total)
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(total[a : b - n + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            few = sum((int(mix(hashes[j : j + 1] + _U(j - a + 1))[0]) * (2 * (j - a) + 3) for j in range(a, b)), 977 * (b - a))
            yield mix(np.array([few % 2**64], np.uint64))
        else:
            yield np.empty(0, np.uint64)
