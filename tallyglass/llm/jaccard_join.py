"""Groups of documents whose sets of word n-grams are alike, exactly.

The join is a prefix join with combinations of tokens (n-grams). Tokens are
ordered from rare to frequent. Of two sets that reach the similarity, each lacks
a bounded number of the other's tokens, so

* a prefix with more rare tokens than that shares one of them: rare tokens are
  indexed alone;
* where the rare ones don't suffice, the prefix goes on into the frequent tokens
  until more common ones are sure than there can be gaps between them: then two
  common tokens are neighbours in both sets, so frequent tokens are indexed as
  combinations of `2` neighbouring ones. That needs a prefix of only a few times
  the allowed difference, and as many signatures as it has tokens.

Tokens that one document alone has can't match anything. A first exchange finds
them, by blocks of the hash space, and with them most documents end: those with
more tokens of their own than the similarity allows. What is left keeps its shared
tokens only, by which intersections are still exact. Equal sets become one class.

Pairs within a signature are not listed. A first round verifies each class
against one leader, the smallest of a signature. Where a signature still holds
different components, all classes that share one of the leader's signatures are a
family: each is described by the few tokens that set it apart from the leader, and a
family is compared from these in blocks, which return only links that connect
something new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import bucket_count, by_bucket, gram_hashes, gram_rows, lowered, planes, prepare, runs, stored, texts_of, trimmed, unplaned, word_hashes, word_spans

#: Classes that hold a rare token, at most.
RARE = 8
#: Classes of a family that are compared at once with as many others, and tasks that each such block is joined in.
FAMILY, SALTS = 1024, 8
#: Families (a leader and a number each, under 20 bytes) whose sizes are broadcast; beyond, they are joined by exchange.
SMALL = 1_000_000
_BLOBS = "bucket int, kind int, data binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_SINGLE, _KNOWN, _MEMBER, _SIZE = 0, 1, 2, 3


def _rows(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*parts, strict=True)
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], schema=_ARROW)


def _pack(ids: np.ndarray, blocks: np.ndarray, h: np.ndarray) -> bytes:
    s, n = runs(ids)
    return b"".join([np.array([len(s), len(h)], np.int64).tobytes(), ids[s].astype("<i8").tobytes(), blocks[s].astype("<i4").tobytes(), planes(n, "<i4"), h.astype("<u8").tobytes()])


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, n = (int(x) for x in np.frombuffer(b, np.int64, 2))
    counts = unplaned(b[16 + 12 * docs : 16 + 16 * docs], docs, "<i4")
    return np.repeat(np.frombuffer(b, "<i8", docs, 16), counts), np.repeat(np.frombuffer(b, "<i4", docs, 16 + 8 * docs), counts), np.frombuffer(b, "<u8", n, 16 + 16 * docs)


def _members(ids: np.ndarray, blocks: np.ndarray, h: np.ndarray) -> list[tuple[int, int, bytes]]:
    o = np.lexsort((ids, blocks))
    ids, blocks, h = ids[o], blocks[o], h[o]
    return [(int(blocks[a]), _MEMBER, _pack(ids[a : a + m], blocks[a : a + m], h[a : a + m])) for a, m in zip(*runs(blocks), strict=True)]


def _split(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    o = np.argsort(bucket, kind="stable")
    s, n = runs(bucket[o])
    return o, [(int(bucket[o[a]]), slice(a, a + m)) for a, m in zip(s, n, strict=True)]


def ngram_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each document, with their document, and each document's number of them."""
    data = lowered(data)
    starts, ends, counts = word_spans(data, off)
    h = word_hashes(data, starts, ends)
    at, row, _ = gram_rows(counts, k)
    g = gram_hashes(h, k)[at]
    for m in range(1, k):
        if len(short := np.flatnonzero(counts == m)):
            first = np.cumsum(counts)[short] - m
            g, row = np.concatenate([g, gram_hashes(h, m)[first]]), np.concatenate([row, short])
    o = np.argsort(row, kind="stable")
    g, row = g[o], row[o]
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for a, m in zip(*runs(row), strict=True):
        x = np.sort(g[a : a + m])
        x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        sizes[row[a]] = len(x)
        sets.append(x)
    return np.concatenate(sets) if sets else g[:0], np.repeat(np.arange(len(counts)), sizes), sizes


def _sizes(k: int):
    """Sizes of the sets of rows without an id, one row each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in texts_of(batch.column(0)):
                sizes = ngram_sets(data, off, k)[2]
                none = pa.nulls(len(sizes), pa.int64())
                yield pa.record_batch([none, pa.array(sizes, pa.int64()), none], names=["id", "n", "component"])

    return of


def _index_tokens(k: int, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            blocks = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, data, off in texts_of(batch.column(2)):
                h, row, sizes = ngram_sets(data, off, k)
                here = slice(lo, lo + len(sizes))
                out = []
                o, parts = _split(blocks[here])
                for b, at in parts:
                    out.append((b, _SIZE, ids[here][o[at]].astype("<i8").tobytes() + sizes[o[at]].astype("<i8").tobytes()))
                row = row + lo
                o = np.argsort(h)
                s, n = runs(h[o])
                alone = np.zeros(len(h), bool)
                alone[o[s[n == 1]]] = True
                known = h[o[s[n > 1]]]
                out += _members(ids[row[~alone]], blocks[row[~alone]], h[~alone])
                for kind, x, r in ((_SINGLE, h[alone], row[alone]), (_KNOWN, known, None)):
                    o, parts = _split(((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int32))
                    for b, at in parts:
                        i = o[at]
                        out.append((b, kind, x[i].tobytes() if r is None else _pack(ids[r[i]], blocks[r[i]], x[i])))
                if out:
                    yield _rows(out)

    return of


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one block of the hash space: the documents of tokens that more than one has."""
    parts, known = [], []
    for batch in batches:
        passed = []
        for b, kind, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == _SINGLE:
                parts.append(_unpack(x))
            elif kind == _KNOWN:
                known.append(np.frombuffer(x, "<u8"))
            else:
                passed.append((b, kind, x))
        if passed:
            yield _rows(passed)
    if parts:
        ids, blocks, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.argsort(h)
        hs = h[o]
        shared = np.zeros(len(h), bool)
        twice = hs[1:] == hs[:-1]
        shared[1:] |= twice
        shared[:-1] |= twice
        if known:
            there = np.unique(np.concatenate(known))
            at = np.minimum(np.searchsorted(there, hs), len(there) - 1)
            shared |= there[at] == hs
        i = o[shared]
        if len(i):
            yield _rows(_members(ids[i], blocks[i], h[i]))


_SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("same", T.BinaryType())])


def _gather(num: int, den: int):
    """Of one block of documents: each one's size, and its shared tokens if they suffice for a partner."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, sizes = [], []
        for batch in batches:
            for _, kind, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == _SIZE:
                    sizes.append(np.frombuffer(x, "<i8").reshape(2, -1))
                else:
                    ids, _, h = _unpack(x)
                    members.append((ids, h))
        if not sizes:
            return
        ids, n = np.concatenate(sizes, axis=1)
        o = np.lexsort((-n, ids))
        ids, n = ids[o], n[o]
        s, _ = runs(ids)
        ids, n = ids[s], n[s]
        of_id, h = (np.concatenate(x) for x in zip(*members, strict=True)) if members else (ids[:0], np.zeros(0, np.uint64))
        o = np.lexsort((h, of_id))
        of_id, h = of_id[o], h[o]
        one = np.concatenate([[True], (of_id[1:] != of_id[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
        of_id, h = of_id[one], h[one]
        a, b = np.searchsorted(of_id, ids, "left"), np.searchsorted(of_id, ids, "right")
        for lo in range(0, len(ids), 500):
            tokens, same = [], []
            for i in range(lo, min(lo + 500, len(ids))):
                m, size = int(b[i] - a[i]), int(n[i])
                if size and m * den >= num * size:
                    x = h[a[i] : b[i]]
                    tokens.append(x.view(np.int64))
                    same.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if m == size else None)
                else:
                    tokens.append(None)
                    same.append(None)
            yield pa.record_batch([pa.array(ids[lo : lo + 500]), pa.array(n[lo : lo + 500]), pa.array(tokens, pa.list_(pa.int64())), pa.array(same, pa.binary())], names=["id", "n", "tokens", "same"])

    return of


def signatures(df: np.ndarray, h: np.ndarray, n: int, num: int, den: int, rare: int) -> np.ndarray:
    """Of a set of n tokens, of which those in h are in df > 1 sets: what it shares with each set that reaches num / den."""
    own = n - len(h)
    lacks, differs = n - -(-n * num // den), n * (den - num) // num
    if own > lacks or not differs:
        return h[:0]
    o = np.lexsort((h, df))
    df, h = df[o], h[o]
    few = int(np.searchsorted(df, rare, "right"))
    alone = h[: min(few, lacks + 1 - own)]
    if own + few > lacks:
        return alone
    left = own + few
    many = h[few : few + (lacks - left) + max(differs - left, 0) + 2]
    return np.concatenate([alone, gram_hashes(many, 2)])


def _sign(num: int, den: int, rare: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, ids, sizes = [], [], []
            for i, n, tokens in zip(*(batch.column(c) for c in ("id", "n", "shared")), strict=True):
                x = tokens.values
                s = signatures(x.field("df").to_numpy(), x.field("h").to_numpy().view(np.uint64), n.as_py(), num, den, rare)
                sig.append(s.view(np.int64))
                ids.append(np.full(len(s), i.as_py(), np.int64))
                sizes.append(np.full(len(s), n.as_py(), np.int64))
            if sig:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (sig, ids, sizes)], names=["sig", "id", "n"])

    return of


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes that reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").withColumn("both", both).where(F.col("both") * den >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _family_links(num: int, den: int):
    """Of one or two blocks of a family: links that connect what isn't connected yet, at most as many as members.

    Sets come as what sets them apart from the family's leader. What sets two apart
    is then the symmetric difference of these short lists, so an index of them
    gives every intersection in the cell.
    """

    def of(t: pa.Table) -> pa.Table:
        ids, n, m, part, own = (t[c].to_numpy() for c in ("id", "n", "m", "part", "own"))
        lists = t["apart"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        _, token = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        member = np.repeat(np.arange(len(ids)), size)
        o = np.argsort(token, kind="stable")
        holders, many = member[o], np.bincount(token)
        first = np.cumsum(many) - many
        end = np.cumsum(size)
        _, root = np.unique(part, return_inverse=True)
        across = len(np.unique(own)) > 1
        a, b = [], []
        for x in range(len(ids)):
            mine = token[end[x] - size[x] : end[x]]
            k = many[mine]
            at = np.repeat(first[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            shared = np.bincount(holders[at], minlength=len(ids))
            both = (m + m[x] - (size + size[x] - 2 * shared)) // 2
            linked = (both * den >= num * (n + n[x] - both)) & (root != root[x])
            if across:
                linked &= own != own[x]
            for r in np.unique(root[linked]):
                a.append(ids[x])
                b.append(ids[np.flatnonzero(linked & (root == r))[0]])
            if linked.any():
                root[np.isin(root, root[linked])] = root[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return of


def jaccard_groups(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """One row per id: id, n (size of its set) and component (smallest id reachable by links).

    A set holds the distinct runs of k words of the lower-cased (A-Z) text; with
    fewer words, the whole sequence as one; without words it is empty and linked
    with nothing. Two ids link when the sets' intersection is at least num / den of
    their union, similarity being (num, den). The links are found exactly.

    Null and empty texts: n 0, a component of their own. Each row without an id is
    kept, with the size of its set and no component: no id can name its links.
    Repeated rows count once; an id names one document, so texts that
    repeat an id are taken as one set. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    num, den = similarity
    if 4 * num < 3 * den:
        rare = 1 << 62  # the prefix of neighbours would be longer than the set; tokens alone are exact at any similarity
    n = bucket_count(docs)
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null").select("id", block.alias("block"), "text")
    blobs = by_bucket(rows.mapInArrow(trimmed(_index_tokens(k, n)), _BLOBS), n, "bucket").mapInArrow(trimmed(_shared_tokens), _BLOBS)
    sets = stored(by_bucket(blobs, n, "bucket").mapInArrow(trimmed(_gather(num, den)), _SETS), "sets")

    left = sets.where("tokens is not null")
    one = left.where("same is not null").groupBy("same").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = stored(one.unionByName(left.where("same is null").select(F.lit(None).cast("binary").alias("same"), "id", "n", "tokens")), "classes")
    names = stored(classes.where("same is not null").select("same", F.col("id").alias("rep")), "names")
    member = left.where("same is not null").select("id", "same").join(names, "same").select("id", "rep")

    tokens = classes.select("id", "n", F.explode("tokens").alias("h"))
    often = stored(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    shared = tokens.join(often, "h").groupBy("id").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "h")).alias("shared"))
    signed = stored(shared.mapInArrow(trimmed(_sign(num, den, rare)), "sig long, id long, n long"), "signatures")

    led = stored(signed.groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("sig", "a"), "leaders")
    first = stored(signed.join(led, "sig").where("a < id").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")), "first")
    links = stored(_verified(first, classes, num, den), "links")
    parts = stored(connected_components(links), "parts")
    named = signed.join(parts, "id", "left").select("sig", "id", "n", F.coalesce("component", "id").alias("part"))
    named = stored(named.join(led.select("sig"), "sig", "left_semi"), "named")
    mixed = stored(named.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("sig"), "mixed")
    family = named.join(mixed, "sig", "left_semi").join(led, "sig").select(F.col("a").alias("lead"), "id", "n", "part").distinct()
    family = stored(family, "families")
    sizes = stored(family.groupBy("lead").agg(F.count("*").alias("m"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("lead", F.ceil(F.col("m") / FAMILY).cast("int").alias("blocks")), "family_sizes")
    # a leader's set goes to each block and salt of its family, so that a large family is joined in many tasks
    own_set = classes.select("id", F.col("tokens").alias("tx"))
    each = sizes.select("lead", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") * SALTS - 1)).alias("salt"))
    lead_set = each.join(classes.select(F.col("id").alias("lead"), F.col("tokens").alias("tl")), "lead").drop("blocks")
    salted = family.join(F.broadcast(sizes) if sizes.count() <= SMALL else sizes, "lead").join(own_set, "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks") * SALTS).cast("int"))
    apart = salted.join(lead_set, ["lead", "salt"]).select("lead", "id", "n", "part", "blocks", F.floor(F.col("salt") / SALTS).cast("int").alias("own"), F.size("tx").alias("m"), F.concat(F.array_except("tl", "tx"), F.array_except("tx", "tl")).alias("apart"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = apart.select("*", other.alias("other")).select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "part", "m", "apart")
    more = stored(cells.groupBy("lead", "i", "j").applyInArrow(_family_links(num, den), "a long, b long"), "links")
    whole = stored(connected_components(links.unionByName(more)), "components")

    # classes to their members; members whose class has links to the component
    rep = member.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("part"))
    alone = whole.withColumnRenamed("component", "part")
    part = stored(rep.unionByName(alone).groupBy("id").agg(F.min("part").alias("part")), "membership")
    named_rows = sets.select("id", "n").join(part, "id", "left").select("id", "n", F.coalesce("part", "id").alias("component"))
    nameless = docs.where(F.col(id_col).cast("long").isNull()).select(F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(_sizes(k)), "id long, n long, component long")
    return named_rows.unionByName(nameless)
