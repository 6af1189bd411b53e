"""Removal of passages that repeat earlier text, by windows of words.

The reference is the whole corpus, cut into blocks by the hash of its windows of
`window` words. Every block indexes its windows by their earliest place and answers
with it for each window that it knows from earlier text. A document is then parsed
greedily, from left to right, relative to that reference: at the first word that
starts a known window a factor begins, and it is drawn out as long as the next word still
follows in the document that it refers to. The search goes on at the factor's boundary, with the windows
that start inside it and reach beyond its end, so a factor may overlap the one before.
Factors have `window` words at least and are the duplicate spans: their words go.

Scale: one exchange of 8 to 10 bytes for each window that is new within its
chunk (a passage that many documents share costs one entry a chunk, so no block
is hot), one of the answers and one of the texts, by blocks of documents.
Nothing is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bucket_count, by_bucket, gram_hashes, gram_rows, planes, prepare, runs, stored, texts_of, trimmed, unplaned, word_hashes, word_spans

NO_ID = np.iinfo(np.int64).max
FACTOR = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ref_id", T.LongType()), T.StructField("ref_start", T.LongType())]))
_BLOBS = "__tg_bucket int, __tg_kind int, __tg_blob binary"
_INDEX, _ANSWER, _TEXT = 0, 1, 2
_ARROW = pa.schema([("__tg_bucket", pa.int32()), ("__tg_kind", pa.int32()), ("__tg_blob", pa.binary())])


def _rows(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*parts, strict=True)
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], schema=_ARROW)


def _pack(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray, *more: tuple[np.ndarray, str]) -> bytes:
    """Entries in the order of their documents; ids and keys are of each entry."""
    s = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
    n = np.diff(np.append(s, len(ids)))
    step = np.diff(pos, prepend=0).astype(np.int32)
    return b"".join([np.array([len(s), len(ids)], np.int64).tobytes(), ids[s].astype("<i8").tobytes(), keys[s].astype("<i8").tobytes(), planes(n, "<i4"), planes(step, "<i4"), *(planes(x, kind) for x, kind in more)])


def _unpack(b: bytes, *kinds: str) -> list[np.ndarray]:
    docs, n = (int(x) for x in np.frombuffer(b, np.int64, 2))
    at = 16
    ids = np.frombuffer(b, "<i8", docs, at)
    keys = np.frombuffer(b, "<i8", docs, at := at + 8 * docs)
    counts = unplaned(b[(at := at + 8 * docs) : at + 4 * docs], docs, "<i4")
    at += 4 * docs
    out = [np.repeat(ids, counts), np.repeat(keys, counts), np.cumsum(unplaned(b[at : at + 4 * n], n, "<i4"), dtype=np.int64)]
    at += 4 * n
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(unplaned(b[at : at + size], n, kind))
        at += size
    return out


def _later(h: np.ndarray, ids: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries whose hash has an earlier (id, key, pos); for those the entry of the earliest; entries that stand for each hash."""
    o = np.argsort(h)
    hs = h[o]
    again = np.concatenate([[False], hs[1:] == hs[:-1]]) if len(h) else np.zeros(0, bool)
    group = again.copy()
    group[:-1] |= again[1:]
    single, some = o[~group], o[group]
    some = some[np.lexsort((pos[some], keys[some], ids[some], h[some]))]
    s, n = runs(h[some])
    first = np.repeat(some[s], n)
    later = (ids[some] != ids[first]) | (keys[some] != keys[first]) | (pos[some] != pos[first])
    return some[later], first[later], np.sort(np.concatenate([single, some[s]]))


def _answers(buckets: int, ids: np.ndarray, keys: np.ndarray, pos: np.ndarray, ref: np.ndarray, ref_pos: np.ndarray) -> list[tuple[int, int, bytes]]:
    blocks = keys % buckets
    o = np.lexsort((pos, ids, keys, blocks))
    ids, keys, blocks, pos, ref, ref_pos = (x[o] for x in (ids, keys, blocks, pos, ref, ref_pos))
    s, n = runs(blocks)
    return [(int(blocks[a]), _ANSWER, _pack(ids[a : a + m], keys[a : a + m], pos[a : a + m], (ref[a : a + m], "<i8"), ((ref_pos - pos)[a : a + m], "<i4"))) for a, m in zip(s, n, strict=True)]


def _index_windows(window: int, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, data, off in texts_of(batch.column(2)):
                starts, ends, counts = word_spans(data, off)
                at, row, start = gram_rows(counts, window)
                if not len(at):
                    continue
                h = gram_hashes(word_hashes(data, starts, ends), window)[at]
                row += lo
                later, first, stand = _later(h, ids[row], keys[row], start)
                out = _answers(buckets, ids[row[later]], keys[row[later]], start[later], ids[row[first]], start[first])
                h, row, start = h[stand], row[stand], start[stand]
                bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                o = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                h, row, start = h[o], row[o], start[o]
                s, n = runs(bucket[o])
                for b, a, m in zip(bucket[o][s], s, n, strict=True):
                    r = row[a : a + m]
                    out.append((int(b), _INDEX, _pack(ids[r], keys[r], start[a : a + m], (h[a : a + m], "<u8"))))
                yield _rows(out)

    return of


def _answer_from_blocks(buckets: int):
    """One block of the reference: every index entry of some hashes. Answers from the chunks pass through."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            passed = []
            for b, kind, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                passed.append((b, kind, x)) if kind == _ANSWER else parts.append(_unpack(x, "<u8"))
            if passed:
                yield _rows(passed)
        if parts:
            ids, keys, pos, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            later, first, _ = _later(h, ids, keys, pos)
            if len(later):
                yield _rows(_answers(buckets, ids[later], keys[later], pos[later], ids[first], pos[first]))

    return of


def _parse(pos: np.ndarray, ref: np.ndarray, shift: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The document's factors (start, length, ref_id, ref_start), greedily from the left, from what the blocks know of its windows.

    A factor goes on while the window at the next place is known at the next place of
    the same reference; where it ends, the next known window, which may start
    inside it, begins another.
    """
    ends = np.flatnonzero((pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1]))
    out, a = [], 0
    for end in [*ends.tolist(), len(pos) - 1]:
        start = int(pos[a])
        out.append((start, end - a + window, int(ref[a]), start + int(shift[a])))
        a = end + 1
    return out


def _spans(factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The factors' words as spans that don't touch."""
    out: list[tuple[int, int]] = []
    for start, length, *_ in factors:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length))
        else:
            out.append((start, start + length))
    return out


def _rewrite(window: int, names: list[str], id_col: str, text_col: str, out: pa.Schema):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        ready = None
        met: set[int] = set()
        for batch in batches:
            kinds = batch.column("__tg_kind").to_numpy()
            if (n := int((kinds == _ANSWER).sum())) and (kinds[:n] == _ANSWER).all():
                for x in batch.column("__tg_blob").slice(0, n).to_pylist():
                    ids, keys, *more = _unpack(x, "<i8", "<i4")
                    parts.append([ids, keys, *more])
                batch = batch.slice(n)
            if not len(batch):
                continue
            if ready is None:
                ids, keys, pos, ref, shift = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
                o = np.lexsort((ref, pos, ids, keys))
                ids, keys, pos, ref, shift = ids[o], keys[o], pos[o], ref[o], shift[o]
                one = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])]) if len(ids) else np.zeros(0, bool)
                ready = [x[one] for x in (ids, keys, pos, ref, shift)]
                parts.clear()
            ids, keys, pos, ref, shift = ready
            n_words, n_removed, kept, factors = [], [], [], []
            texts = batch.column(text_col).cast(pa.large_binary())
            for i, key, t in zip(batch.column(id_col).to_pylist(), batch.column("__tg_key").to_pylist(), texts, strict=True):
                words = (t.as_py() or b"").split()
                n_words.append(len(words))
                a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                doc = NO_ID if i is None else int(i)
                a, b = a + np.searchsorted(ids[a:b], doc, "left"), a + np.searchsorted(ids[a:b], doc, "right")
                copy = i is None and key in met
                if i is None:
                    met.add(key)
                if copy and len(words) >= window:  # all of it starts in an earlier row
                    n_removed.append(len(words))
                    factors.append([{"start": 0, "length": len(words), "ref_id": int(NO_ID), "ref_start": 0}])
                    words = []
                elif a == b:
                    n_removed.append(0)
                    factors.append([])
                else:
                    found = _parse(pos[a:b], ref[a:b], shift[a:b], window)
                    spans = _spans(found)
                    n_removed.append(sum(y - x for x, y in spans))
                    factors.append([dict(zip(("start", "length", "ref_id", "ref_start"), f, strict=True)) for f in found])
                    words = [w for x, y in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(words)], strict=True) for w in words[x:y]]
                kept.append(b" ".join(words))
            cols = [batch.column(c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, out.field("factors").type)]
            yield pa.record_batch(cols, schema=out)

    return of


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with n_words, n_removed, kept_text and factors (start, length, ref_id, ref_start in words).

    A word goes if a window of `window` consecutive words covers it whose word
    sequence also starts earlier: under a smaller id, or earlier in the same
    document. Words are runs of anything but space, tab to carriage return; the
    kept ones are joined by one space. kept_text keeps one copy of everything.

    Null and empty texts have no words: 0, 0, "" and no factors. Rows without
    an id come after all others, each as a document of its own; they, and rows that
    repeat an id with another text, are ordered by a hash of the text. Of equal texts
    without an id one row is the first. Rows that repeat an id and its text get
    equal results: neither is earlier than the other. Input
    columns named like an output are replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    outputs = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("factors", FACTOR)]
    names = [c for c in docs.columns if c not in {f.name for f in outputs}]
    docs = docs.select(*names)
    n = bucket_count(docs)
    # equal texts without an id share a key, and so a bucket, where the first in the order of the other columns stays
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    block = F.pmod(key, F.lit(n)).cast("int")
    seeds = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).alias("text")).mapInArrow(trimmed(_index_windows(window, n)), _BLOBS)
    answers = stored(by_bucket(seeds, n, "__tg_bucket").mapInArrow(trimmed(_answer_from_blocks(n)), _BLOBS), "factors")
    order = F.when(F.col(id_col).isNull(), F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]))
    texts = docs.withColumns({"__tg_bucket": block, "__tg_kind": F.lit(_TEXT), "__tg_key": key, "__tg_order": order})
    both = by_bucket(answers.unionByName(texts, allowMissingColumns=True), n, "__tg_bucket").sortWithinPartitions("__tg_kind", "__tg_order")
    schema = T.StructType([*docs.schema.fields, *outputs])
    from pyspark.sql.pandas.types import to_arrow_schema

    return both.mapInArrow(trimmed(_rewrite(window, names, id_col, text_col, to_arrow_schema(schema))), schema)
