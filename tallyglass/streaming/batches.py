"""Reconciliation of a stream, one boundary per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import fingerprints
from ..functions.model import Policy, ReconError, late_window_seconds
from ..operators.reconcile import Reconciliation, reconcile


def watermarked(stream: DataFrame, policy: Policy, column: str = "ts") -> DataFrame:
    """The policy's late-arrival window as a watermark."""
    seconds = late_window_seconds(policy.late_arrival_window)
    if seconds is None:
        raise ReconError(f"no late-arrival window: {policy.late_arrival_window}")
    return stream.withWatermark(column, f"{seconds} seconds")


def reconcile_stream(stream: DataFrame, sink_of: Callable[[int], DataFrame], policy: Policy, salt: bytes, done: Callable[[int, Reconciliation], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of the source is reconciled with sink_of(batch); done gets the result. A batch that runs again gives the same result."""

    def each(batch: DataFrame, number: int) -> None:
        done(number, reconcile(fingerprints(batch, policy, salt), fingerprints(sink_of(number), policy, salt), policy.hash_algorithm))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_commitment(stream: DataFrame, policy: Policy, salt: bytes, column: str, every: str) -> DataFrame:
    """Count and exclusive or of fingerprints for each window of event time; summed in the stream's state."""
    x = watermarked(stream, policy, column)
    fp = fingerprints(x.withColumn("pos_ts", F.col(column)), policy, salt)
    word = [F.conv(F.hex(F.substring("fp", 4 * i + 1, 4)), 16, 10).cast("long") for i in range(8)]
    return fp.groupBy(F.window("pos_ts", every)).agg(F.count("*").alias("count"), *(F.bit_xor(w).alias(f"w{i}") for i, w in enumerate(word)))
