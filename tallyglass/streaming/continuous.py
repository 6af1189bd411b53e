"""Continuous reconciliation of two streams, with late arrivals.

Each identity keeps the numbers of copies of its contents on both sides. Its window
closes when event time has passed its last record by the late-arrival window; only then
is it judged and its state dropped, so what arrives late is matched and not reported as
missing. An identity that comes again after that is judged anew.

Scale: state is keyed by buckets of identities, so that a batch costs one call for each
bucket and not for each identity; it holds open windows only, some 90 bytes for each
content, so buckets should be as many as open identities need, at some thousands each:
buckets_for() tells, and a worker's memory then doesn't grow with the streams.
Equal records of a batch are counted before the exchange, so a hot record is a few rows.
A bucket's timer is the first window that closes in it. Event time is the slower
stream's, so a sink that lags isn't missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import fingerprints
from ..functions.model import Policy, ReconError, late_window_seconds

_SCHEMA = pa.schema([("id_hash", pa.binary()), ("content_hash", pa.binary()), ("s", pa.int64()), ("k", pa.int64()), ("ms", pa.int64())])
_COUNTED = "id_hash binary, content_hash binary, s long, k long, ms long"
#: Keys of the state, at least, and records of one side for each.
BUCKETS, EACH = 256, 4096
#: What is known of an identity when its window closes.
RESULT = "id_hash binary, source_multiplicity long, sink_multiplicity long, matched long, mutated_copies long, missing long, closed_ms long"


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        g = pa.Table.from_batches([b]).group_by(["id_hash", "content_hash"]).aggregate([("s", "sum"), ("k", "sum"), ("ms", "max")])
        yield from g.select(["id_hash", "content_hash", "s_sum", "k_sum", "ms_max"]).rename_columns(["id_hash", "content_hash", "s", "k", "ms"]).to_batches()


_KEPT = ["id_hash", "content_hash", "s", "k", "ms"]


def _judge(window_ms: int):
    """Of one bucket: its open identities and what came are merged; those whose window has closed are judged, the others stay until the first of them is due."""

    def of(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_all()] if state.exists else []
        parts += [pa.Table.from_pandas(p[_KEPT], _SCHEMA, preserve_index=False) for p in rows]
        x = pa.concat_tables(parts).group_by(["id_hash", "content_hash"]).aggregate([("s", "sum"), ("k", "sum"), ("ms", "max")]).to_pandas()
        x = x.set_axis(_KEPT, axis=1)
        closes = x.groupby("id_hash", sort=False)["ms"].transform("max") + window_ms
        now = state.getCurrentWatermarkMs()
        due = closes < now
        if not due.all():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _SCHEMA) as out:
                out.write_table(pa.Table.from_pandas(x[~due], _SCHEMA, preserve_index=False))
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(int(max(closes[~due].min(), now) + 1))
        elif state.exists:
            state.remove()
        if due.any():
            g = x[due].assign(matched=x[["s", "k"]].min(axis=1), closes=closes).groupby("id_hash", sort=False).agg({"s": "sum", "k": "sum", "matched": "sum", "closes": "max"}).reset_index()
            left_s, left_k = g["s"] - g["matched"], g["k"] - g["matched"]
            yield pd.DataFrame({"id_hash": g["id_hash"], "source_multiplicity": g["s"], "sink_multiplicity": g["k"], "matched": g["matched"], "mutated_copies": left_s.combine(left_k, min), "missing": (left_s - left_k).clip(lower=0), "closed_ms": g["closes"]})

    return of


def _counted(stream: DataFrame, policy: Policy, salt: bytes, column: str, delay: str, source: bool) -> DataFrame:
    x = fingerprints(stream.withColumn("pos_ts", F.col(column).cast("timestamp")), policy, salt)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    x = x.where("pos_ts is not null").select("id_hash", "content_hash", (one if source else none).alias("s"), (none if source else one).alias("k"), F.unix_millis("pos_ts").alias("ms"))
    return x.mapInArrow(_combined, _COUNTED).withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", delay)


def buckets_for(records: int) -> int:
    """Buckets for so many records of one side that may be open at once. A checkpoint goes with one number of buckets."""
    return max(BUCKETS, -(-records // EACH))


def continuous(source: DataFrame, sink: DataFrame, policy: Policy, salt: bytes, column: str = "ts", delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream of RESULT, one row for each identity when its window closes.

    source and sink are streams of records with an event time in column; the policy's
    late_arrival_window closes an identity, delay is how far records of one stream come
    out of order. Records without an event time never close and are left out. Windows that
    are open when the streams end give no row; a record that comes after event time has
    passed its own time by delay is dropped by Spark unless it shares a batch with a newer
    equal one.
    """
    seconds = late_window_seconds(policy.late_arrival_window)
    if seconds is None:
        raise ReconError(f"no late-arrival window: {policy.late_arrival_window}")
    both = _counted(source, policy, salt, column, delay, True).unionByName(_counted(sink, policy, salt, column, delay, False))
    return both.withColumn("bucket", F.pmod(F.xxhash64("id_hash"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(_judge(seconds * 1000), RESULT, "open binary", "append", "EventTimeTimeout")


def run_continuous(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, written as Parquet to path; with the same checkpoint a later call goes on where this one ends, also after a crash."""
    return results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
