"""Vectorised text kernels over Arrow string buffers (numpy, no Python loop
over characters or words)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256).astype(U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; works in place on its own copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse, 0 to n - 1 at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null has no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, size: int, rows: int = 8192):
    """Ranges of at most so many rows, of about size bytes; a longer row is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and its row. Words are runs of ASCII letters
    and digits and of non-ASCII characters."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off[:-1]] = edge[off[1:]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(len(raw))
    prefix = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=prefix[1:])
    return mix((prefix[e] - prefix[s]) * down[s]), np.searchsorted(off, s, "right") - 1


def word_shingles(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every run of width words, and each one's row, by row. A
    row of fewer words, but at least one, has one shingle of all its words."""
    word, row = words(raw, off)
    if not len(word):
        return word, row
    counts = np.bincount(row, minlength=len(off) - 1)
    short = (counts[row] < width) & np.r_[True, row[1:] != row[:-1]]
    total, whole = word.copy(), np.ones(len(word), bool)
    for k in range(1, width):
        total *= U64(0xD6E8FEB86659FD93)
        whole[len(row) - k :] = False
        same = row[k:] == row[:-k]
        whole[: len(row) - k] &= same
        total[: len(row) - k] += np.where(same, word[k:], U64(0))
    use = whole | short
    return mix(total[use]), row[use]


def repetition(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each row the share of words that equal the one before."""
    word, row = words(raw, off)
    same = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    rows = len(off) - 1
    return np.bincount(row[1:][same], minlength=rows) / np.maximum(np.bincount(row, minlength=rows), 1)


def char_shingles(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of every run of width characters, by row, with each row's
    start and count. A shorter row, but not an empty one, has one shingle."""
    chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
    pos = first[off]
    n = np.diff(pos)
    count = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    starts = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=starts[1:])
    if not len(chars):
        return np.zeros(0, U64), starts[:-1], count
    up, down = powers(len(chars) + 1)
    prefix = np.zeros(len(chars) + 1, U64)
    np.cumsum((chars.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F) * up[: len(chars)], out=prefix[1:])
    at = np.arange(starts[-1]) + np.repeat(pos[:-1] - starts[:-1], count)
    stop = np.minimum(at + width, np.repeat(pos[1:], count))
    return mix((prefix[stop] - prefix[at]) * down[at]), starts[:-1], count


def fast_sketch(values: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Fast similarity sketches (rows x bins) of the sets of 64-bit values.

    Round i < bins throws each element into a random bin with value i + v;
    round bins + i throws each into bin i. A coordinate keeps its least value,
    so it is settled by the first round that reaches it, and after 2 * bins
    rounds none is empty. Rows that are full leave; a set of n elements needs
    about bins * log(bins) / n rounds. Rows without elements stay at the
    maximum.
    """
    empty = np.iinfo(np.uint64).max
    sk = np.full(rows * bins, empty, U64)
    for i in range(2 * bins):
        if not len(values):
            break
        h = mix(values + U64((0xA0761D6478BD642F * (i + 1)) & (2**64 - 1)))
        place = ((h >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        np.minimum.at(sk, row * bins + place, (h & U64(0xFFFFFFFF)) | U64(i << 32))
        open_row = (sk.reshape(rows, bins) == empty).any(axis=1)
        more = open_row[row]
        if not more.all():
            values, row = values[more], row[more]
    return sk.reshape(rows, bins)


def minhash(values: np.ndarray, starts: np.ndarray, count: np.ndarray, hashes: int) -> np.ndarray:
    """Classical MinHash signatures (rows x hashes, uint32); needs count > 0."""
    rng = np.random.default_rng(99)
    a = rng.integers(0, 2**31, hashes).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, hashes).astype(np.uint32)
    low = (values >> U64(32)).astype(np.uint32)
    out, turn = np.empty((hashes, len(starts)), np.uint32), np.empty_like(low)
    if len(starts):
        for k in range(hashes):
            np.multiply(low, a[k], out=turn)
            np.bitwise_xor(turn, b[k], out=turn)
            np.minimum.reduceat(turn, starts, out=out[k])
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per row and band, of all coordinates of the band."""
    rows, width = len(sig), sig.shape[1] // bands
    part = sig.reshape(rows, bands, width).astype(U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (rows, bands))
    for k in range(width):
        key = mix(key ^ mix(part[:, :, k] + U64(k + 1)))
    return key.view(np.int64)


def overlap(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets kept as sorted distinct 64-bit values."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if not len(x) or not len(y):
        return 0.0
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(x) + len(y) - common)
