"""BLAKE3 for Arrow batches: all chunks of all values of a batch are compressed side by side in numpy.

Written from the published specification. A value is cut into chunks of 1,024 bytes, a
chunk into blocks of 64; chunks' values are paired level by level, an odd last one
moving up, until the root is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the specification: initial words, the message's permutation, and flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _mix(v: list[np.ndarray], a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    for m, first, second in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + m
        v[d] = _turn(v[d] ^ v[a], first)
        v[c] = v[c] + v[d]
        v[b] = _turn(v[b] ^ v[c], second)


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """(8, n) chaining values of n blocks of 16 words."""
    n = words.shape[1]
    v = [*cv, *(np.full(n, x, np.uint32) for x in IV[:4]), (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)
    for _ in range(7):
        for i in range(4):
            _mix(v, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _mix(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[i] for i in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def blake3_many(values: list[bytes]) -> list[bytes]:
    """The 32-byte hash of each value."""
    if not values:
        return []
    count = np.array([max(1, -(-len(x) // CHUNK)) for x in values])
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(values)), count)
    number = np.arange(count.sum()) - first[owner]
    length = np.minimum(np.array([len(x) for x in values])[owner] - number * CHUNK, CHUNK)
    data = np.zeros((len(owner), CHUNK), np.uint8)
    for i, (x, k) in enumerate(zip(owner, number, strict=True)):
        part = values[x][k * CHUNK : (k + 1) * CHUNK]
        data[i, : len(part)] = np.frombuffer(part, np.uint8)
    words = data.view("<u4").reshape(len(owner), 16, 16)
    blocks = np.maximum(1, -(-length // BLOCK))
    cv = np.repeat(IV[:, None], len(owner), axis=1)
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = (CHUNK_START if b == 0 else 0) + last * (CHUNK_END + ROOT * (count[owner[live]] == 1))
        cv[:, live] = compress(cv[:, live], words[live, b].T, number[live], np.minimum(length[live] - b * BLOCK, BLOCK), flags)
    while len(owner) > len(values):  # pairs of neighbours of one value
        at = np.arange(len(owner)) - np.searchsorted(owner, owner)
        size = np.bincount(owner)[owner]
        left = np.flatnonzero((at % 2 == 0) & (at + 1 < size))
        made = compress(np.repeat(IV[:, None], len(left), axis=1), np.concatenate([cv[:, left], cv[:, left + 1]]), np.zeros(len(left), np.int64), np.full(len(left), BLOCK), PARENT + ROOT * (size[left] == 2))
        cv[:, left] = made
        keep = at % 2 == 0
        cv, owner = cv[:, keep], owner[keep]
    raw = np.ascontiguousarray(cv.T.astype("<u4")).tobytes()
    return [raw[32 * i : 32 * i + 32] for i in range(len(values))]


def _hashed(data: pa.Array) -> pa.Array:
    x = data.to_pylist()
    it = iter(blake3_many([v for v in x if v is not None]))
    return pa.array([None if v is None else next(it) for v in x], pa.binary())


def blake3_column(data: Column) -> Column:
    return F.arrow_udf(_hashed, T.BinaryType())(data)


def _folded(nodes: pa.Array, levels: pa.Array) -> pa.Array:
    out = []
    for x, n in zip(nodes.to_pylist(), levels.to_pylist(), strict=True):
        rows = [x]
        for _ in range(n):
            a = rows[-1]
            rows.append(blake3_many([b"\x10" + a[i] + a[min(i + 1, len(a) - 1)] for i in range(0, len(a), 2)]))
        out.append(rows)
    return pa.array(out, pa.list_(pa.list_(pa.binary())))


def blake3_levels(nodes: Column, levels: Column) -> Column:
    return F.arrow_udf(_folded, T.ArrayType(T.ArrayType(T.BinaryType())))(nodes, levels)


def _climbed(leaf: pa.Array, idx: pa.Array, proof: pa.Array) -> pa.Array:
    out = []
    for h, i, steps in zip(leaf.to_pylist(), idx.to_pylist(), proof.to_pylist(), strict=True):
        for s in steps:
            h, i = blake3_many([b"\x10" + (s + h if i & 1 else h + s)])[0], i >> 1
        out.append(h)
    return pa.array(out, pa.binary())


def blake3_climb(leaf: Column, idx: Column, proof: Column) -> Column:
    return F.arrow_udf(_climbed, T.BinaryType())(leaf, idx, proof)
