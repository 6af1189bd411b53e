"""Chains of documents by the hash of the one before: forks, gaps, cycles, current heads.

Each link points to the one before. Pointers are doubled: in every round a link takes
over where its pointer points and adds the distances, so a chain of n links is done
after log2(n) rounds; a round in which none arrives leaves only cycles and what leads
into them.

Scale: links are numbered in the order of their rows and looked up by name once; rounds
join (number, pointer, distance) by exchange. Where most links are near the one before,
as in a table that is written in order, each block of 65,536 numbers is first followed
by one task to where its chains leave it, and only those ends go into rounds: all links
are exchanged four times, whatever the length of chains. In other orders each round
exchanges the links that haven't arrived and what they may point to. Every step's result
is a table in the shared folder, so lineage doesn't grow; a link that has arrived is
written once. A link with very many successors is one key of a join: the joined side has
one row a link, and Spark splits the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import dropped, stored

#: A block's numbers have all but these bits in common.
BLOCK = 16


def _within(block: pa.Table) -> pa.Table:
    """Follows a block's links to the last in the block (top, hops); those on a cycle in the block stay where they are."""
    num, to = block["num"].to_numpy(), block["to"].fill_null(-1).to_numpy()
    order, here = np.argsort(num), np.arange(len(num))
    at = order[np.minimum(np.searchsorted(num, to, sorter=order), len(num) - 1)]
    inside = num[at] == to
    top, hops = np.where(inside, at, here), inside.astype(np.int64)
    for _ in range(len(num).bit_length()):
        if not inside[top].any():
            break
        hops, top = hops + hops[top], top[top]
    cycle = inside[top]
    top, hops = np.where(cycle, here, top), np.where(cycle, 0, hops)
    added = {"top": num[top], "hops": hops, "successors": np.bincount(at[inside], minlength=len(num)).astype(np.int64), "far": ~inside & (to >= 0)}
    return pa.table({c: block[c] for c in ("num", "id", "prev", "to")} | {c: pa.array(v) for c, v in added.items()})


def _numbered(links: DataFrame) -> DataFrame:
    """Distinct (id, prev) with numbers in the order of rows."""
    x = stored(links.withColumn("num", F.monotonically_increasing_id()), "links")
    if (x.groupBy("id").count().agg(F.max("count")).first()[0] or 1) == 1:
        return x
    two = (F.min("prev") != F.max("prev")) | F.count("prev").between(1, F.count("*") - 1)
    n = x.groupBy("id").agg(F.max("prev").alias("prev"), F.min("num").alias("num"), two.alias("two"))
    one = F.when(F.col("two"), F.raise_error(F.concat(F.lit("a document with two predecessors: "), F.col("id").cast("string"))).cast("string")).otherwise(F.col("prev"))
    once = stored(n.select("id", one.alias("prev"), "num"), "links")
    dropped(x)
    return once


def chain_links(links: DataFrame, id_col: str = "proof_id", prev_col: str = "prev_proof_hash") -> DataFrame:
    """(id, prev, root, depth, state, successors, head) for each link.

    root: the chain's first link, at depth 0; state: "start", "linked", "gap" (the link
    before isn't there; the root of what follows it), "cycle" (on a cycle or behind one; root
    and depth are null). successors: links that name it; more than one is a fork. head: a
    link of a proper chain without successors. Repeated rows count once; of rows that
    repeat an id with another pointer, each is an error. Null ids are left out; no links
    give no rows.
    """
    x = _numbered(links.select(F.col(id_col).alias("id"), F.col(prev_col).alias("prev")).where("id is not null"))
    base = stored(x.join(x.select(F.col("id").alias("prev"), F.col("num").alias("to")), "prev", "left").select("num", "id", "prev", "to"), "links")
    dropped(x)
    block = lambda c: F.shiftright(c, BLOCK)
    near, linked = base.agg(F.count_if(block("to") == block("num")), F.count("to")).first()
    inner = base.withColumns({"top": F.col("num"), "hops": F.lit(0).cast("long"), "successors": F.lit(0).cast("long"), "far": F.col("to").isNotNull()})
    ends = inner.where("to is not null and top = num").select("num", "to", F.lit(1).cast("long").alias("steps"))
    tables = []
    if 2 * near > linked:
        inner = stored(base.groupBy(block("num").alias("block")).applyInArrow(_within, inner.schema), "blocks")
        dropped(base)
        leaving = stored(inner.where("to is not null and top = num").select("num", "to"), "ends")
        ends = stored(leaving.join(inner.select(F.col("num").alias("to"), "top", "hops"), "to").select("num", F.col("top").alias("to"), (F.col("hops") + 1).alias("steps")), "pointers")
        tables = [leaving, ends]
    roots = stored(inner.where("to is null").select("num", "id"), "roots")
    named = stored(inner.where("far").groupBy(F.col("to").alias("num")).agg(F.count("*").alias("named")), "named")
    open_, done = ends, [stored(roots.select("num", F.col("num").alias("to"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("arrived")), "round")]
    left, before = open_.count(), None
    while left and left != before:
        # a pointer to a link that has arrived arrives with it; any other takes over that link's pointer
        hops = open_.withColumn("arrived", F.lit(False))
        for d in done:
            hops = hops.unionByName(d.where("arrived"))
        y = open_.join(hops.select(F.col("num").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), "arrived"), "to")
        done.append(stored(y.select("num", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), "arrived"), "round"))
        open_ = done[-1].where("not arrived").drop("arrived")
        left, before = open_.count(), left
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d.where("arrived"))
    found = found.join(roots.select(F.col("num").alias("to"), F.col("id").alias("root")), "to").select(F.col("num").alias("top"), "root", "steps")
    found = stored(found, "arrived")
    dropped(roots, *done, *tables)
    out = inner.join(found, "top", "left").join(named, "num", "left").withColumn("successors", F.col("successors") + F.coalesce("named", F.lit(0)))
    state = F.when(F.col("root").isNull(), "cycle").when(F.col("prev").isNull(), "start").when(F.col("to").isNull(), "gap").otherwise("linked")
    return out.select(
        "id", F.coalesce("prev", F.lit(None).cast("string")).alias("prev"), "root", (F.col("steps") + F.col("hops")).alias("depth"),
        state.alias("state"), "successors", (F.col("root").isNotNull() & (F.col("successors") == 0)).alias("head"),
    )
