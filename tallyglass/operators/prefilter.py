"""Digests of hash ranges, so that only ranges which differ are compared row by row.

The rows of both sides fall into ranges by the first bits of id_hash, so an identity is
in one range. A range's digest is its numbers of rows and the sums of words (126 bits)
that two seeded 64-bit hashes make of a row's own hashes, source minus sink: it is all zero where both sides hold the same
multiset. Ranges that differ are cut into smaller ones on the next level, and what
differs on the last is reconciled; the others matched, copy by copy.

Scale: digests are summed before the exchange, so a level exchanges at most one row for
each range and task, whatever the number of rows: with the first level's 1,024 ranges
and a million rows a task, a thousandth. Ranges that differ are broadcast: 2^18 at most.
Two different multisets have equal digests by accident once in 2^126; whoever can choose
contents may find such sums, so a proof's commitments stay the Merkle roots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stores import dropped, stored
from .reconcile import Reconciliation, reconcile

#: Bits by which each level cuts its ranges.
FAN = (10, 8)
_WORDS = 6


def range_of(bits: int) -> Column:
    """The number that the first bits of id_hash make."""
    return F.shiftright(F.conv(F.hex(F.substring("id_hash", 1, 4)), 16, 10).cast("long"), 32 - bits)


def digests(rows: DataFrame, bits: int) -> DataFrame:
    """(range, source_rows, sink_rows, differs) of rows (id_hash, content_hash, sign), sign 1 for the source's and -1 for the sink's."""
    x = rows.select(range_of(bits).alias("range"), "sign", *(F.xxhash64(F.lit(i), "id_hash", "content_hash").alias(f"h{i}") for i in range(_WORDS // 3)))
    word = lambda i: F.shiftright(f"h{i // 3}", 21 * (i % 3)).bitwiseAND(F.lit((1 << 21) - 1))
    words = [F.sum(F.col("sign") * word(i)).alias(f"w{i}") for i in range(_WORDS)]
    d = x.groupBy("range").agg(F.count_if(F.col("sign") == 1).alias("source_rows"), F.count_if(F.col("sign") == -1).alias("sink_rows"), *words)
    differs = F.col("source_rows") != F.col("sink_rows")
    for i in range(_WORDS):
        differs = differs | (F.col(f"w{i}") != 0)
    return d.select("range", "source_rows", "sink_rows", differs.alias("differs"))


@dataclass(frozen=True)
class Prefiltered:
    """The comparison of what differs, and how many rows of each side are in ranges that are equal."""

    differing: Reconciliation
    source: DataFrame
    equal_rows: int
    tables: list[DataFrame]
    bits: tuple[int, ...]

    @property
    def levels(self) -> DataFrame:
        """(level, ranges, differing, source_rows, sink_rows): ranges with rows, how many differ, and the rows in those."""
        out = None
        for i, d in enumerate(self.tables, 1):
            of = lambda c: F.coalesce(F.sum(F.when(F.col("differs"), F.col(c))), F.lit(0)).cast("long").alias(c)
            row = d.agg(F.count("*").alias("ranges"), F.count_if("differs").alias("differing"), of("source_rows"), of("sink_rows")).select(F.lit(i).alias("level"), "*")
            out = row if out is None else out.unionByName(row)
        return out

    def summary(self) -> DataFrame:
        """One row like a reconciliation's of all rows."""
        more = {c: (F.col(c) + self.equal_rows).alias(c) for c in ("source_count", "sink_count", "matched")}
        s = self.differing.summary()
        return s.select(*(more.get(c, F.col(c)) for c in s.columns))

    @property
    def missing(self) -> DataFrame:
        return self.differing.missing

    @property
    def mutated(self) -> DataFrame:
        return self.differing.mutated

    @property
    def duplicated(self) -> DataFrame:
        return self.differing.duplicated

    @property
    def matched(self) -> DataFrame:
        """Source rows with an equal sink row: those of equal ranges, and what matched in the others."""
        last = self.tables[-1].where("differs").select("range")
        equal = self.source.withColumn("range", range_of(self.bits[-1])).join(F.broadcast(last), "range", "left_anti")
        return self.differing._with_fp(equal.select("id_hash", "content_hash", "pos")).unionByName(self.differing.matched)

    def release(self) -> None:
        """Drops what is kept and the levels' tables."""
        self.differing.release()
        dropped(*self.tables)


def prefilter(source: DataFrame, sink: DataFrame, algorithm: str = "sha256", fan: tuple[int, ...] = FAN) -> Prefiltered:
    """Like reconcile, with the same results, for sides that are expected to be nearly equal.

    fan: bits of each level, 32 in all at most. The levels run when this is called. Empty
    sides are equal; a side of null hashes isn't possible. Other columns than the
    fingerprints' are dropped.
    """
    whole = reconcile(source, sink, algorithm)
    sides = {1: whole.source, -1: whole.sink}
    tables: list[DataFrame] = []
    bits: list[int] = []

    def left(df: DataFrame) -> DataFrame:
        if not tables:
            return df
        last = tables[-1].where("differs").select("range")
        return df.withColumn("range", range_of(bits[-1])).join(F.broadcast(last), "range", "left_semi").drop("range")

    for step in fan:
        both = None
        for sign, df in sides.items():
            x = left(df).select("id_hash", "content_hash", F.lit(sign).alias("sign"))
            both = x if both is None else both.unionByName(x)
        tables.append(stored(digests(both, (bits[-1] if bits else 0) + step), f"digests-{len(tables)}"))
        bits.append((bits[-1] if bits else 0) + step)
    total = tables[0].agg(F.sum("source_rows")).first()[0] or 0
    differing = tables[-1].where("differs").agg(F.sum("source_rows")).first()[0] or 0
    return Prefiltered(reconcile(*map(left, sides.values()), algorithm), whole.source, total - differing, tables, tuple(bits))
