"""Multiset comparison of a source and a sink by identity and content.

Within an identity, equal contents match one to one, what is left over is paired in
the order of positions (mutated), and unpaired source rows are missing. An identity
with more sink than source rows is duplicated; one without a source row at all is a
phantom among them.

Scale: a first pass counts records by a 64-bit hash of the identity and the first 16 bytes
of the content's hash, in a hash aggregate before the exchange, so a hot record is a row
with two counts, and a record costs an exchange of 24 bytes and not of its whole hashes
and position. Identities whose counts are equal on both sides matched, copy by copy; two
contents of one identity are taken for equal by accident once in 2^128. What is known of
the others is their number and a set of bits, about 16 for each, that is broadcast up to
FEW of them. A second pass hashes both sides again and keeps (on disk where memory is
short, until release()) the rows whose bit is set, with all their hashes and positions:
all rows of each uneven identity, and one in 16 or fewer of the others, which change no
result. Neither side is kept whole.

Of the kept rows nearly all of a result follows from counts. Positions are read only for
groups with other numbers on both sides. Where these are at most SMALL groups they are
broadcast, else joined by exchange. Their rows are ranked; groups of over RANGE rows are
dealt by sampled quantiles of their order, whatever the positions' type, and a row's rank
is its place in its part and the sizes of the parts before, so no group is one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.hashing import fingerprint_hash
from ..functions.model import DuplicatePolicy, Tolerances
from ..sources.stores import dropped, stored

SOURCE, SINK = "source", "sink"
#: Rows of a group that one task ranks.
RANGE = 1 << 20
#: Groups with other numbers on both sides (under 200 bytes each) that are broadcast.
SMALL = 200_000
#: Uneven records whose bits (some 12 bytes for each) are broadcast.
FEW = 1 << 24
_GROUP = ["id_hash", "content_hash"]


def spot() -> Column:
    """A number for the identity, whose first bits are its place among the bits of marked()."""
    return F.xxhash64("id_hash")


def marked(df: DataFrame, found: DataFrame, n: int, kept: bool = True) -> DataFrame:
    """The rows of df whose identity has its bit set by one of the n rows of found (spot), or the others: all rows of found's identities, and one in 16 or fewer of the rest."""
    if not n:
        return df.limit(0) if kept else df
    bits = max(6, (16 * n - 1).bit_length())
    place = lambda c: F.shiftrightunsigned(c, 64 - bits)
    one = F.expr("shiftleft(1L, cast(__place & 63 as int))")
    words = found.select(place("spot").alias("__place")).groupBy(F.shiftright("__place", 6).alias("__word")).agg(F.bit_or(one).alias("__bits"))
    x = df.withColumn("__place", place(spot())).withColumn("__word", F.shiftright("__place", 6))
    x = x.join(F.broadcast(words) if n <= FEW else words, "__word", "inner" if kept else "left")
    unset = F.col("__bits").bitwiseAND(one) == 0
    return x.where(~unset if kept else F.col("__bits").isNull() | unset).select(*(F.col(f"`{c}`") for c in df.columns))


def ranked(rows: DataFrame, keys: list[str], groups: DataFrame | None, rank: str, tables: list[DataFrame] | None = None) -> DataFrame:
    """rows with rank, from 1, within keys by pos (nulls last), then content_hash.

    groups has keys and size of each group; those of over RANGE rows are at most one for
    every RANGE rows: they are broadcast. Their rows are written once, dealt by ranges of
    keys and order; rows that are equal in both are interchangeable and are dealt anyhow.
    Without groups none is larger. The table that is written is added to tables.
    """
    order = [F.col("pos").asc_nulls_last(), F.col("content_hash")]
    within = lambda *more: F.row_number().over(Window.partitionBy(*keys, *more).orderBy(*order))
    if groups is None:
        return rows.withColumn(rank, within())
    big = groups.where(F.col("size") > RANGE)
    total = big.agg(F.sum("size")).first()[0]
    if not total:
        return rows.withColumn(rank, within())
    x = rows.join(F.broadcast(big.select(*keys, F.lit(True).alias("__big"))), keys, "left")
    small = x.where("__big is null").drop("__big").withColumn(rank, within())
    x = x.where("__big").drop("__big").withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    x = stored(x.repartitionByRange(math.ceil(total / RANGE) + 1, *keys, *order, "__tie").withColumn("__part", F.spark_partition_id()).drop("__tie"), "ranges")
    if tables is not None:
        tables.append(x)
    sizes = x.groupBy(*keys, "__part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(F.broadcast(sizes.select(*keys, "__part", before.alias("before"))), [*keys, "__part"])
    return small.unionByName(x.withColumn(rank, (within("__part") + F.col("before")).cast("long")).drop("__part", "before"))


@dataclass(frozen=True)
class Reconciliation:
    """Frames of a comparison. source and sink have id_hash, content_hash and pos; algorithm makes a fingerprint of both hashes.

    counts, identities and what is made of them are of the kept rows only; all others matched.
    """

    source: DataFrame
    sink: DataFrame
    algorithm: str = "sha256"
    tables: list[DataFrame] = field(default_factory=list)

    @cached_property
    def _first(self) -> tuple[int, int, int, DataFrame]:
        """Rows of both sides, records with other numbers on both, and a hash of each of these records' identities; one job."""
        key = [spot().alias("spot"), F.substring("content_hash", 1, 16).alias("content")]
        side = lambda df, s, k: df.select(*key, F.lit(s).cast("long").alias("s"), F.lit(k).cast("long").alias("k"))
        n = side(self.source, 1, 0).unionByName(side(self.sink, 0, 1)).groupBy("spot", "content").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
        seen = Observation()
        uneven = F.col("s") != F.col("k")
        n = n.observe(seen, F.sum("s").alias("s"), F.sum("k").alias("k"), F.count_if(uneven).alias("n"))
        found = stored(n.where(uneven).select("spot"), "uneven")
        self.tables.append(found)
        got = seen.get
        return got["s"] or 0, got["k"] or 0, got["n"], found

    def _marked(self, df: DataFrame, kept: bool) -> DataFrame:
        return marked(df, self._first[3], self._first[2], kept)

    @cached_property
    def _kept(self) -> dict[str, DataFrame]:
        return {name: self._marked(df, True).persist(StorageLevel.MEMORY_AND_DISK) for name, df in ((SOURCE, self.source), (SINK, self.sink))}

    @property
    def even(self) -> DataFrame:
        """The source rows that aren't kept: as often in the sink."""
        return self._marked(self.source, False)

    @cached_property
    def counts(self) -> DataFrame:
        """(id_hash, content_hash, s, k): copies on both sides, of the kept rows."""
        both = self._kept[SOURCE].select(*_GROUP, F.lit(0).alias("side")).unionByName(self._kept[SINK].select(*_GROUP, F.lit(1).alias("side")))
        n = both.groupBy(*_GROUP).agg(F.count_if(F.col("side") == 0).alias("s"), F.count_if(F.col("side") == 1).alias("k"))
        return n.persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        """Drops what is kept; what was made of it before isn't to be read any more."""
        if "counts" in self.__dict__:
            self.counts.unpersist()
        for df in self.__dict__.get("_kept", {}).values():
            df.unpersist()
        dropped(*self.tables)
        self.tables.clear()
        for made in ("_first", "_kept", "counts", "_uneven", "identities", "_contested"):
            self.__dict__.pop(made, None)

    def _with_fp(self, df: DataFrame) -> DataFrame:
        columns = [*_GROUP, "fp", *(c for c in df.columns if c not in _GROUP)]
        return df.withColumn("fp", fingerprint_hash(F.col("id_hash"), F.col("content_hash"), self.algorithm)).select(*columns)

    @cached_property
    def _uneven(self) -> tuple[int, int]:
        """Groups with other numbers on both sides, and the most rows that a ranking of theirs can hold; one job, which fills the counts."""
        r = self.counts.where("s != k").agg(F.count("*").alias("n"), F.max(F.greatest("s", "k")).alias("m"), F.sum(F.abs(F.col("s") - F.col("k"))).alias("rest")).first()
        return r.n, max(r.m or 0, r.rest or 0)

    def _ranked(self, rows: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
        return ranked(rows, keys, groups if self._uneven[1] > RANGE else None, "rank", self.tables)

    @cached_property
    def identities(self) -> DataFrame:
        """(id_hash, s, k, left_s, left_k): copies, and copies without an equal one, of each identity."""
        over = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
        return self.counts.groupBy("id_hash").agg(F.sum("s").alias("s"), F.sum("k").alias("k"), over("s", "k").alias("left_s"), over("k", "s").alias("left_k"))

    def _small(self, groups: DataFrame) -> DataFrame:
        return F.broadcast(groups) if self._uneven[0] <= SMALL else groups

    def _rows(self, side: str, groups: DataFrame) -> DataFrame:
        """The side's rows of some groups, with what the groups have."""
        rows = self._kept[side]
        if not self._uneven[0]:
            return rows.limit(0).join(groups.limit(0), _GROUP)
        return rows.join(self._small(groups), _GROUP)

    def _left_over(self, side: str, ids: DataFrame) -> DataFrame:
        """(id_hash, content_hash, pos): the side's copies without an equal one, of some identities."""
        own, other = ("s", "k") if side == SOURCE else ("k", "s")
        groups = self.counts.where(F.col(own) > F.col(other)).join(ids.select("id_hash"), "id_hash", "left_semi").select(*_GROUP, F.col(own).alias("own"), F.col(other).alias("other"))
        alone = self._rows(side, groups.where("other = 0").select(*_GROUP))
        some = groups.where("other > 0")
        partly = self._ranked(self._rows(side, some.select(*_GROUP, "other")), _GROUP, some.select(*_GROUP, F.col("own").alias("size"))).where("rank > other")
        columns = [*_GROUP, "pos"]
        return alone.select(*columns).unionByName(partly.select(*columns))

    @property
    def matched(self) -> DataFrame:
        """Source rows that have an equal sink row: all but those of groups with more source rows, which are ranked."""
        columns = [*_GROUP, "pos"]
        over = self.counts.where("s > k")
        kept = self._kept[SOURCE]
        sure = kept.join(self._small(over.select(*_GROUP)), _GROUP, "left_anti") if self._uneven[0] else kept
        some = over.where("k > 0")
        partly = self._ranked(self._rows(SOURCE, some.select(*_GROUP, "k")), _GROUP, some.select(*_GROUP, F.col("s").alias("size"))).where("rank <= k")
        return self._with_fp(self.even.select(*columns).unionByName(sure.select(*columns)).unionByName(partly.select(*columns)))

    @property
    def matched_fingerprints(self) -> DataFrame:
        """(fp, copies) of what matched, without positions; a fingerprint may be several rows."""
        some = self.counts.where("s > 0 and k > 0").select(*_GROUP, F.least("s", "k").alias("copies"))
        return self._with_fp(self.even.select(*_GROUP, F.lit(1).cast("long").alias("copies")).unionByName(some)).select("fp", "copies")

    @cached_property
    def _contested(self) -> DataFrame:
        return self.identities.where("left_s > 0 and left_k > 0")

    def _paired(self, side: str) -> DataFrame:
        """The side's left-over copies of identities with such on both sides, with rank in the identity."""
        ids = self._contested
        rows = self._left_over(side, ids)
        return self._ranked(rows, ["id_hash"], ids.select("id_hash", F.col("left_s" if side == SOURCE else "left_k").alias("size")))

    @property
    def missing(self) -> DataFrame:
        columns = [*_GROUP, "pos"]
        sure = self._left_over(SOURCE, self.identities.where("left_s > 0 and left_k = 0"))
        ids = self._contested.where("left_s > left_k")
        late = self._paired(SOURCE).join(ids.select("id_hash", "left_k"), "id_hash").where("rank > left_k")
        return self._with_fp(sure.select(*columns).unionByName(late.select(*columns)))

    @property
    def mutated_copies(self) -> DataFrame:
        """(id_hash, source_content_hash, sink_content_hash, copies): how often each pair of contents was paired."""
        both = self._paired(SOURCE).select("id_hash", "rank", "content_hash", F.lit(0).alias("side")).unionByName(self._paired(SINK).select("id_hash", "rank", "content_hash", F.lit(1).alias("side")))
        pairs = both.groupBy("id_hash", "rank").agg(F.max(F.when(F.col("side") == 0, F.col("content_hash"))).alias("source_content_hash"), F.max(F.when(F.col("side") == 1, F.col("content_hash"))).alias("sink_content_hash"))
        pairs = pairs.where("source_content_hash is not null and sink_content_hash is not null")
        return pairs.groupBy("id_hash", "source_content_hash", "sink_content_hash").agg(F.count("*").alias("copies"))

    @property
    def mutated(self) -> DataFrame:
        """Each pair of contents once."""
        return self.mutated_copies.drop("copies")

    @property
    def duplicated(self) -> DataFrame:
        n = self.identities.where("k > s")
        return n.select("id_hash", F.col("s").alias("source_multiplicity"), F.col("k").alias("sink_multiplicity"), (F.col("s") == 0).alias("is_phantom"))

    def summary(self) -> DataFrame:
        """One row: counts of both sides and classes, excess of duplicates."""
        s, k, a, b = (F.col(c) for c in ("s", "k", "left_s", "left_k"))
        none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        n = self.identities.agg(
            none(F.sum(s)).alias("source_count"), none(F.sum(k)).alias("sink_count"), none(F.sum(s - a)).alias("matched"),
            none(F.sum(F.greatest(a - b, F.lit(0)))).alias("missing"), none(F.sum(F.least(a, b))).alias("mutated_copies"),
            F.count_if(k > s).alias("duplicated"), none(F.sum(F.greatest(k - s, F.lit(0)))).alias("duplicate_excess"), F.count_if(s == 0).alias("phantoms"),
        )
        sides = self._first[:2]
        n = n.select(*(x.alias(c) for c, x in ((c, F.lit(sides[0]).cast("long") - F.col("source_count") + F.col("matched") if c == "matched" else F.lit(sides[c == "sink_count"]).cast("long") if c in ("source_count", "sink_count") else F.col(c)) for c in n.columns)))
        pairs = self.mutated_copies.agg(F.count("*").alias("mutated"))
        return n.join(F.broadcast(pairs)).select("source_count", "sink_count", "matched", "missing", "mutated_copies", "mutated", "duplicated", "duplicate_excess", "phantoms")  # one row each


def reconcile(source: DataFrame, sink: DataFrame, algorithm: str = "sha256") -> Reconciliation:
    """source and sink: fingerprints with a pos column (any orderable type, the same on both sides; without one, rows are ordered by content).

    algorithm is the fingerprints'. Both sides are read twice, or more often for what matched; they have to be the same each time.
    Equal positions within a record are interchangeable; null positions come last. Empty sides give counts of 0.
    """

    def side(df: DataFrame) -> DataFrame:
        pos = F.col("pos") if "pos" in df.columns else F.lit(None).cast("long")
        return df.select("id_hash", "content_hash", pos.alias("pos"))

    return Reconciliation(side(source), side(sink), algorithm)


def multiset_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def multiset_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def verdict_of(summary: DataFrame, tolerances: Tolerances = Tolerances(), reason: str | None = None) -> Column:  # noqa: B008
    """PASS, FAIL or UNVERIFIED from the columns of a summary."""
    c = F.col
    if reason is not None:
        return F.lit("UNVERIFIED")
    bad = (c("missing") > tolerances.max_drops) | (c("mutated") > tolerances.max_mutations)
    if tolerances.duplicates is DuplicatePolicy.FORBID:
        bad = bad | (c("duplicated") > 0)
    return F.when(bad, "FAIL").otherwise("PASS")


def balanced() -> Column:
    """Whether a summary's counts add up, on copies of mutated records."""
    return (F.col("matched") + F.col("missing") + F.col("mutated_copies") == F.col("source_count")) & (F.col("matched") + F.col("mutated_copies") <= F.col("sink_count"))


def honest() -> Column:
    """A PASS must have equal counts and nothing missing."""
    return (F.col("verdict") != "PASS") | ((F.col("source_count") == F.col("sink_count")) & (F.col("missing") == 0))
