"""XXH64 of many byte ranges of one buffer at once, with NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
# Fixed values of the published XXH64 algorithm.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Ranges beyond this many bytes go to the library one at a time.
LONG = 256


def rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def xxh64_ranges(data: bytes, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """The unsigned XXH64 of data[start:start + length] for each range."""
    n = len(start)
    out = np.empty(n, U)
    if not n:
        return out
    with np.errstate(over="ignore"):
        buf = data + b"\0" * 8
        u64 = np.ndarray((len(data) + 1,), "<u8", buf, strides=(1,))
        u32 = np.ndarray((len(data) + 1,), "<u4", buf, strides=(1,))
        u8 = np.frombuffer(buf, np.uint8)
        start, length = start.astype(np.int64), length.astype(np.int64)
        big = length >= 32
        h = U(seed) + P5 + length.astype(U)
        at = start.copy()
        if big.any():
            i = np.flatnonzero(big & (length <= LONG))
            v = [np.full(len(i), U(seed) + P1 + P2), np.full(len(i), U(seed) + P2), np.full(len(i), U(seed)), np.full(len(i), U(seed) - P1)]
            for s in range(int(length[i].max(initial=0)) // 32):
                k = np.flatnonzero(length[i] >= 32 * (s + 1))
                for lane in range(4):
                    v[lane][k] = rotl(v[lane][k] + u64[start[i[k]] + 32 * s + 8 * lane] * P2, 31) * P1
            x = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
            for lane in range(4):
                x = (x ^ (rotl(v[lane] * P2, 31) * P1)) * P1 + P4
            h[i] = x + length[i].astype(U)
            at[i] += length[i] // 32 * 32
        rest = length % 32
        for lane in range(3):
            i = np.flatnonzero(rest >= 8 * (lane + 1))
            if not len(i):
                break
            h[i] = rotl(h[i] ^ (rotl(u64[at[i]] * P2, 31) * P1), 27) * P1 + P4
            at[i] += 8
        rest = rest % 8
        i = np.flatnonzero(rest >= 4)
        h[i] = rotl(h[i] ^ (u32[at[i]].astype(U) * P1), 23) * P2 + P3
        at[i] += 4
        rest = rest % 4
        for k in range(3):
            i = np.flatnonzero(rest > k)
            h[i] = rotl(h[i] ^ (u8[at[i]].astype(U) * P5), 11) * P1
            at[i] += 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
        for k in np.flatnonzero(length > LONG):
            h[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + length[k]], seed)
    return h


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, each followed by one space, in one buffer: (buffer, word starts, word ends, words of each text)."""
    parts = [b" ".join(x.split()) for x in texts]
    data = b" ".join(p for p in parts if p)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if data:
        ends = np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    counts = np.fromiter((p.count(b" ") + 1 if p else 0 for p in parts), np.int64, len(parts))
    return data, starts, ends, counts
