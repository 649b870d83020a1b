"""Sparse suffixes of byte texts in numpy: content-chosen anchors, of which every window of a fixed length holds one."""

from __future__ import annotations

import numpy as np

from .shingles import mix

#: Bytes at an anchor that choose it.
GRAM = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a batch that are Python objects at once.
PIECE = 64


def pieces(batches):
    """The Arrow batches in pieces of PIECE rows: a batch has thousands, and what is made of a row takes many times its bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def words8(data: np.ndarray) -> np.ndarray:
    """At each place the 8 bytes from there as a big-endian uint64; 8 bytes fewer places, one more."""
    a = data.astype(np.uint64)
    a = (a[:-1] << np.uint64(8)) | a[1:]
    a = (a[:-2] << np.uint64(16)) | a[2:]
    return (a[:-4] << np.uint64(32)) | a[4:]


def gram_hashes(w8: np.ndarray) -> np.ndarray:
    """At each place a hash of the GRAM bytes from there."""
    n = len(w8) - GRAM + 8
    h = mix(w8[:n] + _ODD)
    for k in range(8, GRAM, 8):
        h = mix(h * _ODD + w8[k : k + n])
    return h


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of each run of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(h: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lo, hi): each anchor with the starts lo to hi of the windows that it stands for.

    A window of ``window`` bytes (or words) stands at the first of its least ``gram`` hashes, so equal windows stand at equal places.
    """
    width = window - gram + 1
    n = len(h) - width + 1  # windows
    least = _sliding(h, width, np.minimum)
    # The last place that the first of the least hashes has moved to, window by window.
    top = _sliding(np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64))), width, np.maximum)
    chosen = np.flatnonzero(top == h)  # places that are least in some window
    # Window i stands at the first chosen place p >= i with h[p] == least[i]: chosen places of a window's least value.
    first = np.searchsorted(chosen, np.arange(n))
    at = chosen[np.minimum(first, len(chosen) - 1)]
    wrong = h[at] != least
    while wrong.any():  # chosen, and in the window, but least in an earlier one only
        k = np.flatnonzero(wrong)
        first[k] += 1
        at[k] = chosen[first[k]]
        wrong = np.zeros(n, bool)
        wrong[k] = h[at[k]] != least[k]
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[cut], cut, np.append(cut[1:], n) - 1


#: Powers of an odd number modulo 2^64 and of its inverse, as far as texts have needed them.
_powers = _inverses = np.ones(1, np.uint64)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _running(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of scrambled bytes below i times powers of an odd number, modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < len(data):
        n = 1 << len(data).bit_length()
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers, _inverses = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x)))) for x in (_ODD, inverse))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers[: len(data)])))


def suffix_rows(text: bytes, length: int, part: int) -> tuple[np.ndarray, ...]:
    """Per anchor: leading 8 bytes, gram hash, reach hash (as int64; the first ordered as the bytes are), place, lo, hi."""
    found: list[tuple[np.ndarray, ...]] = []
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - length + 1, part):
        piece = data[start : start + part + length - 1]
        w8 = words8(piece)
        h = gram_hashes(w8)
        p, lo, hi = anchors(h, length)
        run = _running(piece)
        reach = (run[hi + length] - run[lo]) * _inverses[lo]  # as if it began at 0, so equal reaches have equal sums anywhere
        f = mix(reach + (p - lo).astype(np.uint64) * np.uint64(0x100000001B3) + ((hi - lo).astype(np.uint64) << np.uint64(40)))
        found.append(((w8[p] ^ np.uint64(1 << 63)).astype(np.int64), h[p].astype(np.int64), f.astype(np.int64), (p + start).astype(np.int32), (lo + start).astype(np.int32), (hi + start).astype(np.int32)))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32))
    return tuple(np.concatenate([x[k] for x in found]) for k in range(6))
