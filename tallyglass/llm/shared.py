"""What the operators share: the scratch folder, bucketed exchanges, word hashing.

Every hash here is a fixed function of the bytes, so that a task which runs
again after a lost executor gives the same rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
CHUNK_BYTES = 6 << 20
#: Bytes of input for each bucket of an exchange.
BUCKET_BYTES = 4 << 20
#: Bytes from which the planner's size is taken as a guess (the largest number for unknown sizes, products for joins) and the rows are summed.
UNKNOWN = 1 << 50
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; set only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")

        found = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def prepare(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of its input at once."""
    scratch_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tallyglass/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_count(df: DataFrame) -> int:
    """Buckets for an exchange of what df holds: in proportion to its bytes, at least the session's partitions. A size that the planner doesn't know is summed over the rows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
        size = df.agg(F.sum(sum(wide, F.lit(8 * len(df.columns))).cast("long"))).first()[0] or 0
    return max(partitions(df.sparkSession), math.ceil(size / BUCKET_BYTES))


def by_bucket(df: DataFrame, n: int, column: str) -> DataFrame:
    """Deals rows so that bucket i is partition i, one bucket to a partition."""
    return df.repartitionById(n, F.col(column))


def trimmed(of):
    """The same function of batches, which gives its memory back at the end of a task: workers live on from task to task."""

    def task(batches):
        try:
            yield from of(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def crc_mod(column: Column, k: int) -> Column:
    """crc32 of the column as text, modulo k."""
    return F.crc32(column.cast("string").cast("binary")) % k


# --- words and hashes ---------------------------------------------------------------------------

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit; works in place."""
    x *= _K1
    x ^= x >> _S32
    x *= _K3
    x ^= x >> _S29
    return x


def texts_of(column: pa.Array | pa.ChunkedArray):
    """(first row, bytes, offsets) of chunks of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and each document's number of words. No word crosses a document's end."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins, stops = ~blank, ~blank
    inner = off[(off > 0) & (off < len(data))]
    prev = np.empty_like(blank)
    prev[:1], prev[1:] = True, blank[:-1]
    prev[inner] = True
    after = np.empty_like(blank)
    after[-1:], after[:-1] = True, blank[1:]
    after[inner - 1] = True
    starts, ends = np.flatnonzero(begins & prev), np.flatnonzero(stops & after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) + _K2)
    at, pos = np.arange(len(starts)), starts
    while len(at):
        piece = eights[pos] & _MASKS[np.minimum(left, 8)]
        h[at] = mix(h[at] ^ piece)
        more = left > 8
        at, pos, left = at[more], pos[more] + 8, left[more] - 8
    return h


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _K2 + b)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, by doubling; windows may cross documents."""
    if len(h) < k:
        return h[:0]
    out, at, power, width = None, 0, h, 1
    while True:
        if k & width:
            out = power if out is None else _joined(out[: len(power) - at], power[at : at + len(out)])
            at += width
        if at == k:
            return out[: len(h) - k + 1]
        power = _joined(power[:-width], power[width:])
        width *= 2


def gram_rows(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of k words: index into all windows, row and start within the row."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    n = np.maximum(counts - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first[row] + start, row, start


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def planes(x: np.ndarray, kind: str) -> bytes:
    """An integer array by byte planes, so that the exchange's compression removes high bytes that are zero."""
    a = np.ascontiguousarray(x.astype(kind))
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unplaned(b: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal neighbours."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return s, np.diff(np.append(s, len(sorted_keys)))
