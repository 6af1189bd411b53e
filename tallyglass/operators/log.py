"""An append-only log: roots at any size, and proofs that a later size continues an earlier one.

Leaves have places from 0 in the order of appending. A range of places is tiled by the
largest complete subtrees that lie in it; a size's root joins the tiles of all its places
from the right. A proof between two sizes is the tiles of the old places and those of the
new ones: the first give the old root, all together the new one, so nothing old can have
changed. Tiles never change once their places are filled.

Scale: complete blocks of 2^12 nodes are folded each in one expression, and their roots
again; appended leaves make new blocks only. A tile is read from the blocks at the ends of
a range, at most two on each level, by a filter that reaches the scan; a proof has some
2 log2(n) rows, whatever the log holds.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import LEAF, NODE, merkle_fold, merkle_leaf
from ..sources.stores import stored

BITS = 12
PROOF = "old_size long, new_size long, part string, level int, idx long, hash binary"


def tiles(lo: int, hi: int) -> list[tuple[int, int]]:
    """(level, index) of the largest complete subtrees that tile the places from lo up to, but without, hi."""
    out = []
    while lo < hi:
        level = (lo & -lo).bit_length() - 1 if lo else hi.bit_length() - 1
        while lo + (1 << level) > hi:
            level -= 1
        out.append((level, lo >> level))
        lo += 1 << level
    return out


def log_levels(leaves: DataFrame, size: int, bits: int = BITS) -> list[DataFrame]:
    """Tables (idx, hash) of the levels 0, bits, 2 * bits and so on, of complete blocks. leaves: idx (each place from 0 to size - 1 once) and fp."""
    out = [stored(leaves.select(F.col("idx").cast("long").alias("idx"), merkle_leaf(F.col("fp")).alias("hash")), "log-0")]
    while size >> bits:
        size >>= bits
        x = out[-1].where(F.col("idx") < size << bits).groupBy(F.shiftright("idx", bits).alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), "hash"))).alias("x"))
        x = x.select("idx", F.get(merkle_fold(F.transform("x", lambda s: s.hash), F.lit(bits)), F.lit(0)).alias("hash"))
        out.append(stored(x, f"log-{len(out)}"))
    return out


def _tile_hashes(levels: list[DataFrame], wanted: set[tuple[int, int]], bits: int) -> DataFrame:
    """(level, idx, hash) of some tiles, each from the nodes of the stored level below it."""
    out = None
    for k, nodes in enumerate(levels):
        own = sorted((lv, i) for lv, i in wanted if min(lv // bits, len(levels) - 1) == k)
        if not own:
            continue
        rows = nodes.sparkSession.createDataFrame([(lv, i, i << (lv - k * bits), (i + 1 << (lv - k * bits)) - 1, lv - k * bits) for lv, i in own], "level int, tile long, lo long, hi long, up int")
        blocks = sorted({b for lv, i in own for b in {(i << (lv - k * bits)) >> bits, ((i + 1 << (lv - k * bits)) - 1) >> bits}})
        spans = [F.col("idx").between(b << bits, (b + 1 << bits) - 1) for b in blocks]
        near: Column = spans[0]
        for s in spans[1:]:
            near = near | s
        x = nodes.where(near).join(F.broadcast(rows), F.col("idx").between(F.col("lo"), F.col("hi")))  # some 2 log2(n) tiles against a few blocks
        x = x.groupBy("level", "tile", "up").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("x"))
        x = x.select("level", F.col("tile").alias("idx"), F.get(merkle_fold(F.transform("x", lambda s: s.hash), F.col("up")), F.lit(0)).alias("hash"))
        out = x if out is None else out.unionByName(x)
    return out


def consistency_proofs(levels: list[DataFrame], sizes: list[int], bits: int = BITS) -> DataFrame:
    """PROOF rows from each size to the next: part old are the tiles of the old places, new those of the places since. Sizes rise; none is beyond the log."""
    if sorted(set(sizes)) != list(sizes) or (sizes and sizes[0] < 0):
        raise ValueError("sizes rise from 0 on")
    rows = [(a, b, part, *t) for a, b in zip(sizes, sizes[1:], strict=False) for part, lo, hi in (("old", 0, a), ("new", a, b)) for t in tiles(lo, hi)]
    spark: SparkSession = levels[0].sparkSession
    want = spark.createDataFrame(rows, "old_size long, new_size long, part string, level int, idx long")
    hashes = _tile_hashes(levels, {r[3:] for r in rows}, bits) if rows else None
    return want.withColumn("hash", F.lit(None).cast("binary")) if hashes is None else want.join(F.broadcast(hashes), ["level", "idx"]).select(*want.columns, "hash")


def _joined(found: list[tuple[int, int, bytes]]) -> bytes:
    """The root over neighbouring tiles in order: siblings are joined as they meet, the rest from the right."""
    node = lambda a, b: hashlib.sha256(bytes.fromhex(NODE) + a + b).digest()
    stack: list[tuple[int, int, bytes]] = []
    for level, idx, h in found:
        while stack and stack[-1][0] == level and stack[-1][1] ^ 1 == idx and idx & 1:
            level, idx, h = level + 1, idx >> 1, node(stack.pop()[2], h)
        stack.append((level, idx, h))
    if not stack:
        return hashlib.sha256(bytes.fromhex(LEAF) + bytes(32)).digest()
    out = stack.pop()[2]
    while stack:
        out = node(stack.pop()[2], out)
    return out


def proven_roots(proof: list) -> tuple[bytes, bytes]:
    """The old and the new root that a proof's rows give; rows that don't tile both sizes are an error."""
    a, b = proof[0].old_size, proof[0].new_size
    by = {p: {(r.level, r.idx): bytes(r.hash) for r in proof if r.part == p} for p in ("old", "new")}
    want = {"old": tiles(0, a), "new": tiles(a, b)}
    if any(by[p].keys() != set(want[p]) for p in by):
        raise ValueError(f"no proof from {a} to {b}")
    rows = {p: [(*t, by[p][t]) for t in want[p]] for p in by}
    return _joined(rows["old"]), _joined(rows["old"] + rows["new"])
