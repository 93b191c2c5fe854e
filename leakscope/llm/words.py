"""Words, their hashes and hashed word windows, shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept and doubled as texts get longer."""
    while len(_powers["up"]) < n + 1:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            old = _powers[name]
            _powers[name] = np.concatenate([old, old * U(pow(base, len(old), 1 << 64))])
    return _powers["up"], _powers["down"]


def word_array(text):
    """Column: the maximal runs of letters, digits and underscores of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def word_hashes(text):
    """Column array<bigint>: a hash of each word, in order. The hashing stays in the JVM."""
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes (uint64); empty if there are fewer than n."""
    if len(words) < n:
        return np.empty(0, U)
    size = len(words) - n + 1
    scrambled = mix(words + U(0x9E3779B97F4A7C15))
    out = scrambled[:size].copy()
    for k in range(1, n):
        out *= U(0xC2B2AE3D27D4EB4F)
        out += scrambled[k : k + size]
    return mix(out)


def flat_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column without copying rows; null rows count as empty."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def flat_binaries(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (in values) of an Arrow binary column that holds packed numbers."""
    width = np.dtype(dtype).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.empty(0, dtype), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat.view(dtype), (offsets.astype(np.int64) - offsets[0]) // width


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w consecutive ones, by prefix and suffix minima of blocks."""
    n = len(x)
    if w == 1 or n < w:
        return x if w == 1 else x[:0]
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    pre = np.minimum.accumulate(full, axis=1).ravel()
    suf = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])
