"""Where on a way of several hops copies are lost, changed or added.

The multisets at all hops are counted together: one row for each (identity, content)
with its number of copies at each hop. Between two hops, copies of a content that are
gone and copies that are new are summed by identity; as many as can be are a change,
what is left is lost or added.

Scale: one exchange for any number of hops, of rows that are counted before it, so a hot
record is one row with its numbers; a second, by identity, of sums. Nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GROUP = ["id_hash", "content_hash"]


def hop_counts(hops: list[DataFrame]) -> DataFrame:
    """(id_hash, content_hash, n0, n1, ...): copies at each hop. hops are fingerprints, the source first; an empty hop counts 0."""
    if len(hops) < 2:
        raise ValueError("a way has two hops or more")
    all_of = None
    for i, h in enumerate(hops):
        x = h.select(*_GROUP, F.lit(i).alias("hop"))
        all_of = x if all_of is None else all_of.unionByName(x)
    return all_of.groupBy(*_GROUP).agg(*(F.count_if(F.col("hop") == i).alias(f"n{i}") for i in range(len(hops))))


def hop_faults(hops: list[DataFrame]) -> DataFrame:
    """(id_hash, hop, lost, changed, added, first) for each identity and hop where something happened on the way from the hop before; first marks its first such hop.

    What comes back later counts as added there. No differences give no rows.
    """
    n = hop_counts(hops)
    over = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    steps = range(1, len(hops))
    x = n.groupBy("id_hash").agg(*(c for i in steps for c in (over(f"n{i - 1}", f"n{i}").alias(f"gone{i}"), over(f"n{i}", f"n{i - 1}").alias(f"new{i}"))))
    none = F.lit(0).cast("long")
    each = F.array(*(F.struct(F.lit(i).alias("hop"), F.greatest(F.col(f"gone{i}") - F.col(f"new{i}"), none).alias("lost"), F.least(f"gone{i}", f"new{i}").alias("changed"), F.greatest(F.col(f"new{i}") - F.col(f"gone{i}"), none).alias("added")) for i in steps))
    x = x.select("id_hash", F.posexplode(F.filter(each, lambda s: s.lost + s.changed + s.added > 0)).alias("at", "step"))
    return x.select("id_hash", "step.*", (F.col("at") == 0).alias("first"))


def hop_summary(hops: list[DataFrame]) -> DataFrame:
    """(hop, rows_before, rows_after, lost, changed, added, identities) of each hop after the first; identities: those that something happened to there first."""
    f = hop_faults(hops).groupBy("hop").agg(*(F.sum(c).alias(c) for c in ("lost", "changed", "added")), F.count_if("first").alias("identities"))
    counts = None
    for i, h in enumerate(hops):
        x = h.agg(F.count("*").alias("n")).select(F.explode(F.array(*(F.struct(F.lit(j).alias("hop"), F.lit(j == i).alias("after"), F.col("n")) for j in (i, i + 1) if 1 <= j < len(hops)))).alias("c")).select("c.*")
        counts = x if counts is None else counts.unionByName(x)
    rows = counts.groupBy("hop").agg(F.sum(F.when(~F.col("after"), F.col("n"))).alias("rows_before"), F.sum(F.when(F.col("after"), F.col("n"))).alias("rows_after"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(F.broadcast(f), "hop", "left").select("hop", "rows_before", "rows_after", *map(none, ("lost", "changed", "added", "identities")))  # a row for each hop
