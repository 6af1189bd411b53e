"""Mixing overlapping sources to target weights, by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they are
in). Token capacity of the patterns is routed to the sources' quotas at least cost: the
first pass over a pattern's tokens is free, each repetition costs more than the one
before. Documents of a pattern are then taken in the order of a seeded hash until
they hold the tokens routed through the pattern; the last one is taken in part.

Scale: sizes are a small table made in one pass over the texts. Patterns and sources
are sums (MAX_PATTERNS, checked), solved on the driver. The order within a
pattern is a sum over hash ranges first, so a source with a third of all rows is cut
into many ranges and only the range that holds the limit is ordered finely.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, prepare, stored

#: Membership patterns that the driver routes, at most; more are an error.
MAX_PATTERNS = 20_000
#: Hash ranges of a pattern; a range is ordered as a whole only where a limit falls into it.
RANGES = 4096
CYCLE = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs of anything but space, tab to carriage return; 0 for null."""
    x = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANKS))
    return F.when(F.length(x) == 0, F.lit(0)).otherwise(F.regexp_count(x, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def seeded(id_col: Column, seed: int) -> Column:
    """Hexadecimal order of a document under a seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))


def target_words(sizes: dict[str | None, int], weights: dict[str | None, int], share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """Targets in proportion to weights that sum to share of all sizes; a target stops at most times its source's size and the excess is shared again by weight."""
    total, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        w = sum(open_.values())
        over = [s for s in open_ if total * open_[s] > most * sizes[s] * w]
        if not over:
            return out | {s: total * open_[s] / w for s in open_}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            total -= out[s]
            del open_[s]
    return out


def cycled_weights(sources: list[str | None], cycle: tuple[int, ...] = CYCLE) -> dict[str | None, int]:
    """Weights by the sources' order by code point, null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], most: int = 2) -> dict[tuple, dict[str | None, int]]:
    """Flow of tokens from patterns to the sources in them: as much of the quotas as capacity allows, at least total cost.

    A pattern of n tokens offers n at cost 0, n at cost 1, n at cost 2, ... up to
    most passes. Successive shortest augmentations over the bipartite graph; each
    fills an arc, and a path with repetition r costs no more than one with r + 1.
    """
    flow = {p: dict.fromkeys(p, 0) for p in patterns}
    used = dict.fromkeys(patterns, 0)
    left = dict(quotas)
    holders: dict[str | None, list[tuple]] = {}
    for p in patterns:
        for s in p:
            holders.setdefault(s, []).append(p)
    for level in range(1, most + 1):
        for source in sorted(left, key=repr):
            while left[source] > 0:
                # breadth first from the source's quota to a pattern with room at this level, over flows that can be moved
                back: dict = {source: None}
                queue, goal = [source], None
                while queue and goal is None:
                    later = []
                    for s in queue:
                        for p in sorted(holders.get(s, ()), key=lambda p: (used[p] - patterns[p] * (level - 1), repr(p))):
                            if ("p", p) in back:
                                continue
                            back["p", p] = s
                            if used[p] < patterns[p] * level:
                                goal = p
                                break
                            for t, f in flow[p].items():
                                if f > 0 and t not in back:
                                    back[t] = ("p", p)
                                    later.append(t)
                        if goal is not None:
                            break
                    queue = later
                if goal is None:
                    break
                amount, path, p = min(left[source], patterns[goal] * level - used[goal]), [], goal
                while True:
                    s = back["p", p]
                    path.append((p, s))
                    if back[s] is None:
                        break
                    p = back[s][1]
                    amount = min(amount, flow[p][s])
                used[goal] += amount
                left[source] -= amount
                for i, (p, s) in enumerate(path):
                    flow[p][s] += amount
                    if i + 1 < len(path):
                        flow[path[i + 1][0]][s] -= amount
    return flow


def mix_sources(docs: DataFrame, texts: bool = True, members: Column | None = None, weights: Callable[[list], dict] = cycled_weights, share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row with size, source_size, target (of its first source) and taken (long, long, double, long).
    Without texts, just id_col and these, which spares an exchange of the texts.

    members is the array of a document's sources, by default just source_col; a
    null source is a source of its own. size is the number of words. taken is how
    many words the mix takes of the document, repeats counted: whole passes over the
    document, and of one document for each pattern a part. No document is taken more
    than most times. Reruns agree: the order depends on ids and seed only.

    Null and empty texts have size 0 and give nothing. Rows that repeat an id are
    ordered by size. Null ids are ordered as one id. Input columns named like an
    output are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    outputs = ("size", "source_size", "target", "taken")
    names = [c for c in docs.columns if c not in outputs]
    who = F.array(F.col(source_col).cast("string")) if members is None else F.array_sort(F.array_distinct(members.cast("array<string>")))
    kept = docs.select(*names).withColumns({"__who": who, "size": word_count(F.col(text_col))})
    small = kept.select(F.col(id_col).alias("__id"), "__who", "size", seeded(F.col(id_col), seed).alias("__o"))
    small = stored(small.withColumn("__r", F.conv(F.substring("__o", 1, 3), 16, 10).cast("int")), "sizes")
    ranges = stored(small.groupBy("__who", "__r").agg(F.sum("size").alias("words")), "ranges")
    rows = ranges.groupBy("__who").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["__who"]): int(r["words"]) for r in rows}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = target_words(sizes, weights(list(sizes)), share, most)
    flow = route(patterns, {s: int(t) for s, t in targets.items()}, most)
    plan = []
    for p, n in patterns.items():
        got = sum(flow[p].values())
        first = p[0] if p else None
        t = targets.get(first, Fraction(0)) if p else Fraction(0)
        plan.append((list(p), got // n if n else 0, got % n if n else 0, sizes.get(first, 0), t.numerator / t.denominator))
    table = spark.createDataFrame(plan, "__who array<string>, passes long, rest long, source_size long, target double")  # at most MAX_PATTERNS rows
    who_key = F.to_json(F.struct("__who"))
    table = table.withColumn("__key", who_key).drop("__who")
    # the pattern's rest ends in one hash range
    before = Window.partitionBy("__who").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    at = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("__key", who_key).join(F.broadcast(table), "__key")
    edge = stored(at.where("before < rest and before + words >= rest").select("__key", F.col("__r").alias("edge"), "before"), "edges")
    limits = table.join(edge, "__key", "left").select("__key", "passes", "rest", "edge", "before", "source_size", "target")
    x = small.withColumn("__key", who_key).join(F.broadcast(limits), "__key")
    inside = x.where("__r = edge")
    run = Window.partitionBy("__key").orderBy("__o", F.col("__id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(run), F.lit(0)))))
    outside = x.where("edge is null or __r != edge").withColumn("part", F.when(F.col("__r") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    taken = inside.unionByName(outside).select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), F.col("__key"))
    if not texts:
        return taken.drop("__key")
    taken = taken.groupBy(id_col, "__key", "size").agg(*(F.max(c).alias(c) for c in outputs[1:]))
    rows = kept.withColumn("__key", who_key).drop("__who").alias("l")
    r = taken.alias("r")
    same = F.col(f"l.{id_col}").eqNullSafe(F.col(f"r.{id_col}")) & (F.col("l.__key") == F.col("r.__key")) & (F.col("l.size") == F.col("r.size"))
    return rows.join(r, same, "left").select(*(F.col(f"l.`{c}`") for c in names), F.col("l.size"), *(F.col(f"r.{c}") for c in outputs[1:]))
