"""Word shingles as 64-bit hashes, and one-permutation MinHash with optimal densification, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes of a text that are hashed at once, and the longest word that is hashed so.
PART, LONGEST = 1 << 20, 1 << 16
_orders: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << n.bit_length()
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, np.uint64(x))))) for x in (_ODD, pow(int(_ODD), -1, 1 << 64))]
    return _powers


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)])))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_in(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a UTF-8 text between white space, A-Z lower-cased; places are bytes.

    Long texts are read PART bytes at a time, with the same hashes: a word across a boundary is hashed by itself, and one of
    over LONGEST bytes always by another function.
    """
    data = np.frombuffer(raw.lower(), np.uint8)  # bytes.lower() changes A-Z alone
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    if len(data) <= PART:
        out, apart = _hashed(data, starts, ends), np.flatnonzero(ends - starts > LONGEST)
    else:
        out, apart = np.zeros(len(starts), np.uint64), []
        for at in range(0, len(data), PART):
            i, j = np.searchsorted(starts, (at, at + PART))
            k = j - 1 if j > i and ends[j - 1] > at + PART else j
            out[i:k] = _hashed(data[at : at + PART], starts[i:k] - at, ends[i:k] - at)
            apart += range(k, j)
        apart = np.union1d(np.array(apart, np.int64), np.flatnonzero(ends - starts > LONGEST))
    for i in apart.tolist():
        word = data[starts[i] : ends[i]]
        if len(word) > LONGEST:
            from xxhash import xxh3_64_intdigest

            out[i] = xxh3_64_intdigest(word.tobytes())
        else:
            out[i] = _hashed(word, np.zeros(1, np.int64), np.array([len(word)]))[0]
    return out, starts, ends


def sequences(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k word hashes, in order; of all words if they are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    acc = np.full(n - size + 1, size, np.uint64)
    for d in range(size):
        acc = mix(acc + words[d : n - size + 1 + d] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))
    return acc


def _order(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a filled one: a fixed random permutation of the others."""
    if bins not in _orders:
        rng = np.random.Generator(np.random.PCG64(bins))
        _orders[bins] = np.argsort(rng.random((bins, bins)), axis=1)
    return _orders[bins]


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, of a non-empty set of distinct shingle hashes.

    One permutation deals the hashes to bands * rows bins, whose least hash is the signature; an empty bin takes that of
    the first filled bin in its own random order, so that equal positions agree with the sets' Jaccard probability.
    """
    bins = bands * rows
    h = np.sort(mix(shingles))
    at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # ascends with h
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    values, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[at[first].astype(np.int64)], filled[at[first].astype(np.int64)] = h[first], True
    if len(first) < bins:
        empty = np.flatnonzero(~filled)
        order = _order(bins)[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    grid = values.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return key


def band_keys_of(hashes: np.ndarray, lengths: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The keys of ``band_keys``, a row for each of the non-empty sets whose hashes stand one after another, repeats allowed."""
    bins, n = bands * rows, len(lengths)
    h = mix(hashes)
    at = np.repeat(np.arange(n), lengths) * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    values, filled = np.full(n * bins, ~np.uint64(0)), np.zeros(n * bins, bool)
    np.minimum.at(values, at, h)
    filled[at] = True
    values, filled = values.reshape(n, bins), filled.reshape(n, bins)
    row, empty = np.nonzero(~filled)
    for s in range(0, len(row), 1 << 16):
        r, order = row[s : s + (1 << 16)], _order(bins)[empty[s : s + (1 << 16)]]
        first = filled[r[:, None], order].argmax(axis=1)
        values[r, empty[s : s + (1 << 16)]] = values[r, order[np.arange(len(r)), first]]
    grid = values.reshape(n, bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, j])
    return key


class Ranges:
    """Two 64-bit hashes of any ranges of a sequence of word hashes, equal wherever the words are."""

    ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
    _powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64),) * 2] * 2

    def __init__(self, words: np.ndarray):
        n = len(words)
        if len(Ranges._powers[0][0]) <= n:
            size = 1 << (n + 1).bit_length()
            Ranges._powers = [tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, np.uint64(f))))) for f in (odd, pow(int(odd), -1, 1 << 64))) for odd in Ranges.ODD]
        scrambled = (mix(words), mix(words ^ np.uint64(0x0123456789ABCDEF)))
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * p[0][:n]))) for w, p in zip(scrambled, Ranges._powers, strict=True)]

    def of(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return mix((s[stop] - s[start]) * Ranges._powers[which][1][start] + (stop - start).astype(np.uint64))


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set of distinct shingle hashes."""
    a = mix(shingles + np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = mix(shingles ^ np.uint64(0x0123456789ABCDEF)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def common_counts(values: np.ndarray, lengths: np.ndarray, columns: int = 4096):
    """(i, counts) for each of the sets that ``values`` holds one after another: how many elements set i shares with each set.

    Elements of one set alone share nothing and are left out; the others are multiplied ``columns`` at a time.
    """
    n = len(lengths)
    row = np.repeat(np.arange(n), lengths)
    _, at, held = np.unique(values, return_inverse=True, return_counts=True)
    shared = held[at] > 1
    row, (names, at) = row[shared], np.unique(at[shared], return_inverse=True)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = np.zeros((n, n), np.float32)
    for start in range(0, len(names), columns):
        a, b = np.searchsorted(at, (start, start + columns))
        grid = np.zeros((n, min(columns, len(names) - start)), np.float32)
        grid[row[a:b], at[a:b] - start] = 1
        total += grid @ grid.T
    for i in range(n):
        yield i, total[i].astype(np.int64)
