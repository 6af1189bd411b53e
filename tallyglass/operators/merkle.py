"""Merkle commitments of any number of rows.

Leaves are sorted bytewise and folded in pairs, an odd last one with itself. Equal
leaves are counted before the exchange and stay one row with a count, so a
fingerprint that holds a large part of all rows is no hot task. The order is
global: leaves are dealt by their first bytes, and the sizes of these parts (at
most 65,536 rows) give each leaf its place. Blocks of 2^BITS places are then folded
each in one expression, and their roots again until one is left. How many times
follows from the number of rows, which is counted first (from the files' metadata,
without hashing); only that number and the root reach the driver. Leaves are hashed once
and kept (on disk where memory is short) until spark.catalog.clearCache().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.canon import binary
from ..functions.hashing import COMMUTATIVE, hash_of, merkle_climb, merkle_fold, merkle_leaf, merkle_levels, merkle_node

#: Levels of one block.
BITS = 12


def empty_root(algorithm: str = "sha256") -> Column:
    return hash_of(binary("00" + "00" * 32), algorithm)


def indexed_leaves(fps: DataFrame, fp: str = "fp", algorithm: str = "sha256", weight: str | None = None) -> DataFrame:
    """(leaf, idx, copies): each distinct leaf with its first place in the bytewise order, from 0, and its number of copies.

    weight names a column with the number of copies that a row stands for.
    """
    copies = F.count("*") if weight is None else F.sum(weight)
    x = fps.select(F.col(fp).alias("__fp"), *([weight] if weight else [])).groupBy("__fp").agg(copies.cast("long").alias("copies"))
    x = x.select(merkle_leaf(F.col("__fp"), algorithm).alias("leaf"), "copies").persist(StorageLevel.MEMORY_AND_DISK)  # both the parts' sizes and the places need them
    # hashes are even, so no part is hot, and the order of parts is the order of leaves
    x = x.withColumn("part", F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("int"))
    parts = x.groupBy("part").agg(F.sum("copies").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))  # at most 65,536 rows
    within = F.coalesce(F.sum("copies").over(Window.partitionBy("part").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.join(F.broadcast(parts), "part").withColumn("at", within).select("leaf", (F.col("before") + F.col("at")).cast("long").alias("idx"), "copies")


def _first_blocks(leaves: DataFrame, bits: int) -> DataFrame:
    """(block, nodes): the leaves of each block in order; a run of equal leaves comes as one row a block."""
    last = F.col("idx") + F.col("copies") - 1
    x = leaves.select("leaf", "idx", last.alias("last"), F.explode(F.sequence(F.shiftright("idx", bits), F.shiftright(last, bits))).alias("block"))
    lo, hi = F.greatest("idx", F.shiftleft("block", bits)), F.least("last", F.shiftleft(F.col("block") + 1, bits) - 1)
    x = x.select("block", lo.alias("at"), (hi - lo + 1).cast("int").alias("times"), "leaf")
    x = x.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "times", "leaf"))).alias("x"))
    return x.select("block", F.flatten(F.transform("x", lambda s: F.array_repeat(s.leaf, s.times))).alias("nodes"))


def _next_blocks(roots: DataFrame, bits: int) -> DataFrame:
    x = roots.groupBy(F.shiftright("block", bits).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "root"))).alias("x"))
    return x.select("block", F.transform("x", lambda s: s.root).alias("nodes"))


def _number(fps: DataFrame, weight: str | None) -> int:
    return fps.count() if weight is None else fps.agg(F.sum(weight)).first()[0] or 0


def _stages(leaves: DataFrame, n: int, bits: int, algorithm: str):
    """Of each stage: its first level, how many it folds, its blocks and their roots."""
    blocks, level, depth = _first_blocks(leaves, bits), 0, max(0, n - 1).bit_length()
    while True:
        levels = min(bits, depth - level)
        roots = blocks.select("block", F.get(merkle_fold(F.col("nodes"), F.lit(levels), algorithm), F.lit(0)).alias("root"))
        yield level, levels, blocks, roots
        level += levels
        if level == depth:
            return
        blocks = _next_blocks(roots, bits)


def merkle_root(fps: DataFrame, fp: str = "fp", algorithm: str = "sha256", bits: int = BITS, weight: str | None = None) -> DataFrame:
    """One row: count, merkle_root (binary). No rows give the empty set's root. weight names a column with the number of copies that a row stands for."""
    roots, n = None, _number(fps, weight)
    for *_, roots in _stages(indexed_leaves(fps, fp, algorithm, weight), n, bits, algorithm):
        pass
    return roots.agg(F.max("root").alias("root")).select(F.lit(n).cast("long").alias("count"), F.coalesce("root", empty_root(algorithm)).alias("merkle_root"))


def inclusion_proofs(fps: DataFrame, wanted: DataFrame, fp: str = "fp", algorithm: str = "sha256", bits: int = BITS, weight: str | None = None) -> DataFrame:
    """(leaf, idx, proof) for each distinct leaf of wanted.fp: siblings from the bottom; the smallest place of equal leaves. A leaf that isn't there is an error.

    A block is folded once for all places that are wanted of it.
    """
    leaves = indexed_leaves(fps, fp, algorithm, weight).persist(StorageLevel.MEMORY_AND_DISK)  # each stage reads them
    ask = wanted.select(F.col(fp).alias("__fp")).distinct().select(merkle_leaf(F.col("__fp"), algorithm).alias("leaf"))
    found = ask.join(leaves.select("leaf", "idx"), "leaf", "left")
    found = found.withColumn("idx", F.coalesce("idx", F.raise_error(F.lit("merkle leaf not found")).cast("long")))
    steps = found.select("leaf", "idx", F.lit(None).cast("int").alias("level"), F.lit(None).cast("binary").alias("hash"))  # a tree of one leaf has empty proofs
    for level, levels, blocks, _ in _stages(leaves, _number(fps, weight), bits, algorithm):
        if not levels:
            break
        own = found.select("leaf", "idx", F.shiftright("idx", level).alias("at"))
        places = own.select("at").distinct().groupBy(F.shiftright("at", bits).alias("block")).agg(F.collect_list("at").alias("places"))
        x = blocks.join(places, "block").select("places", F.posexplode(merkle_levels(F.col("nodes"), F.lit(levels), algorithm)).alias("level", "nodes"))
        x = x.select("level", "nodes", F.explode("places").alias("at"))
        local = F.expr(f"shiftright(at & {(1 << bits) - 1}L, level)").cast("int")
        x = x.select("at", (F.col("level") + level).alias("level"), F.get("nodes", F.least(local.bitwiseXOR(F.lit(1)), F.size("nodes") - 1)).alias("hash"))
        steps = steps.unionByName(own.join(x, "at").select("leaf", "idx", "level", "hash"))
    x = steps.groupBy("leaf", "idx").agg(F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "hash")))).alias("x"))
    return x.select("leaf", "idx", F.transform("x", lambda s: s.hash).alias("proof"))


def verified_inclusion(leaf: Column, idx: Column, proof: Column, root: Column, algorithm: str = "sha256") -> Column:
    """Whether the proof leads from the leaf at idx to the root."""
    return merkle_climb(leaf, idx.cast("long"), proof, algorithm) == root


def verified_anywhere(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether it leads there from any place (SHA-256). Tries every side of every step, so its work doubles with each: with a known place take verified_inclusion."""
    both = lambda a, s: F.array_distinct(F.concat(F.transform(a, lambda h: merkle_node(h, s)), F.transform(a, lambda h: merkle_node(s, h))))
    return F.array_contains(F.aggregate(proof, F.array(leaf), both), root)


def commutative_root(fps: DataFrame, fp: str = "fp", algorithm: str = "sha256") -> DataFrame:
    """One row, commutative_root: hash of all fingerprints' exclusive or. Order doesn't matter; equal pairs cancel; summed before the exchange."""
    word = [F.conv(F.hex(F.substring(fp, 4 * i + 1, 4)), 16, 10).cast("long") for i in range(8)]
    x = fps.agg(*(F.coalesce(F.bit_xor(w), F.lit(0)).alias(f"w{i}") for i, w in enumerate(word)))
    return x.select(hash_of(F.concat(binary(COMMUTATIVE), *(F.unhex(F.lpad(F.hex(f"w{i}"), 8, "0")) for i in range(8))), algorithm).alias("commutative_root"))
