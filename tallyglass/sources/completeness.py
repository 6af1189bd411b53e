"""Whether a log was read to the end of its boundary: offsets that are missing, as intervals.

Offsets are marked in bitmaps of 32,768 bits each, made before the exchange. A bitmap
that is full or absent says all about its stretch; only the others are looked into bit by
bit. Neighbouring stretches are joined to intervals at the end.

Scale: the exchange holds a bit for each offset and task that saw it, not a row, and no
offset is listed but those next to a gap; a partition with a third of all rows is many
bitmaps. Ordered steps see a row for each gap or stretch of a partition, never a row for
each offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import Boundary, BoundaryMode, InvalidBoundary

_BITS = 15
_SPAN = 1 << _BITS


def _wanted(spark, boundary: Boundary) -> DataFrame:
    parts = boundary.parsed(BoundaryMode.OFFSET_RANGE).get("partitions")
    try:
        rows = [(int(p["id"]), int(p["start"]), int(p["end"])) for p in parts]
    except (KeyError, TypeError, ValueError) as e:
        raise InvalidBoundary(f"no list of partitions with id, start and end: {e}") from e
    if len({r[0] for r in rows}) < len(rows) or any(r[1] < 0 for r in rows):
        raise InvalidBoundary("a partition is listed twice or begins before 0")
    return spark.createDataFrame(rows, "partition long, start long, end long")


def _bit(bits: Column, i: Column) -> Column:
    byte = F.conv(F.substring(bits, F.shiftright(i, 3) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.expr("0").cast("int") != byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << b) for b in range(8))), i.bitwiseAND(F.lit(7)) + 1))


def offset_gaps(rows: DataFrame, boundary: Boundary, partition: str = "partition", offset: str = "offset") -> DataFrame:
    """(partition, first, last): each longest run of offsets within the boundary (both ends included) that no row has, without a common end with another.

    Rows outside of the boundary and rows with nulls don't count; repeated offsets count
    once; a partition without rows is one gap; a boundary that ends before it starts has
    none. No gaps give no rows.
    """
    want = _wanted(rows.sparkSession, boundary)  # as many rows as the boundary lists partitions
    x = rows.select(F.col(partition).cast("long").alias("partition"), F.col(offset).cast("long").alias("offset")).join(F.broadcast(want), "partition")
    x = x.where(F.col("offset").between(F.col("start"), F.col("end")))
    maps = x.groupBy("partition", "start", "end", F.shiftright("offset", _BITS).alias("stretch")).agg(F.bitmap_construct_agg(F.col("offset").bitwiseAND(F.lit(_SPAN - 1))).alias("bits"))
    lo, hi = F.greatest("start", F.shiftleft("stretch", _BITS)), F.least("end", F.shiftleft(F.col("stretch") + 1, _BITS) - 1)
    maps = maps.select("partition", "start", "end", "stretch", lo.alias("lo"), hi.alias("hi"), F.bitmap_count("bits").alias("seen"), "bits")
    # within a stretch: the places of zero bits, as runs
    holes = maps.where("seen < hi - lo + 1").select("partition", F.shiftleft("stretch", _BITS).alias("base"), "lo", "hi", F.hex("bits").alias("bits"))
    places = F.sequence((F.col("lo") - F.col("base")).cast("int"), (F.col("hi") - F.col("base")).cast("int"))
    empty = F.filter(places, lambda i: ~_bit(F.col("bits"), i))
    runs = holes.select("partition", "base", F.posexplode(empty).alias("i", "at")).groupBy("partition", "base", (F.col("at") - F.col("i")).alias("run"))
    inner = runs.agg((F.min("at") + F.col("base")).alias("first"), (F.max("at") + F.col("base")).alias("last")).select("partition", "first", "last")
    # between stretches that have rows, and before and after them
    w = Window.partitionBy("partition").orderBy("stretch")
    seen = maps.select("partition", "start", "end", "lo", "hi", F.coalesce(F.lag("hi").over(w) + 1, F.col("start")).alias("from"))
    between = seen.where("from < lo").select("partition", F.col("from").alias("first"), (F.col("lo") - 1).alias("last"))
    ends = maps.groupBy("partition").agg(F.max("hi").alias("hi"))
    after = want.join(ends, "partition", "left").select("partition", F.coalesce(F.col("hi") + 1, F.col("start")).alias("first"), F.col("end").alias("last")).where("first <= last")
    gaps = inner.unionByName(between).unionByName(after)
    o = Window.partitionBy("partition").orderBy("first")
    new = F.when(F.col("first") == F.lag("last").over(o) + 1, 0).otherwise(1)
    joined = gaps.withColumn("new", new).withColumn("gap", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("partition", "gap").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("partition", "first", "last")


def completeness(rows: DataFrame, boundary: Boundary, partition: str = "partition", offset: str = "offset") -> DataFrame:
    """(partition, start, end, missing, gaps, verdict) for each partition of the boundary: UNVERIFIED where offsets are missing, else null."""
    want = _wanted(rows.sparkSession, boundary)
    g = offset_gaps(rows, boundary, partition, offset).groupBy("partition").agg(F.sum(F.col("last") - F.col("first") + 1).alias("missing"), F.count("*").alias("gaps"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return want.join(g, "partition", "left").select("partition", "start", "end", none("missing"), none("gaps"), F.when(F.col("gaps") > 0, "UNVERIFIED").alias("verdict"))
