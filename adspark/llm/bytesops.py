"""Vectorised byte-string primitives over Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection on 64-bit words."""
    x = (x ^ (x >> U64(30))) * M1
    x = (x ^ (x >> U64(27))) * M2
    return x ^ (x >> U64(31))


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n+1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    n, start = len(col), col.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], kind)[start : start + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one blank after each and 8 blanks at the end; starts move."""
    n = len(off) - 1
    out = np.full(len(data) + n + 8, 32, np.uint8)
    keep = np.ones(len(data) + n, bool)
    keep[off[1:] + np.arange(n)] = False
    out[: len(keep)][keep] = data
    return out, off + np.arange(n + 1)


def runs_of_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ``spaced`` made."""
    word = np.empty(len(buf) + 1, bool)
    word[0] = False
    np.logical_not(SPACE[buf], out=word[1:])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of buf[start:end]; buf needs 8 spare bytes behind the last end."""
    size = (end - start).astype(np.int64)
    word = np.ndarray((max(len(buf) - 7, 0),), "<u8", buffer=buf, strides=(1,)) if len(buf) >= 8 else np.zeros(0, "<u8")
    h = mix(size.astype(U64) + U64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1)))
    at, live = 0, np.flatnonzero(size > 0)
    while len(live):
        left = size[live] - at
        w = word[start[live] + at]
        cut = np.minimum(left, 8).astype(U64) * U64(8)
        short = left < 8
        w = np.where(short, w & ((U64(1) << np.where(short, cut, U64(0))) - U64(1)), w)
        h[live] = mix((h[live] ^ w) * U64(0x9FB21C651E98DF25) + U64(at))
        at += 8
        live = live[left > 8]
    return h


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[0]..start[0]+size[0]-1, start[1].. and so on."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    live = size > 0
    s, z = start[live], size[live]
    if not len(s):
        return out[:0]
    out[0] = s[0]
    ends = np.cumsum(z)[:-1]
    out[ends] = s[1:] - (s[:-1] + z[:-1] - 1)
    return np.cumsum(out)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[new], np.add.reduceat(counts[order], new) if len(k) else counts[:0]


def uniques(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    k = np.sort(keys)
    if not len(k):
        return k, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[new], np.diff(np.append(new, len(k)))


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in schema], schema=schema)
