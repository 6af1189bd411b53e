"""Boundaries as predicates that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import Boundary, BoundaryMode, InvalidBoundary


def offset_range(b: Boundary, partition: str = "partition", offset: str = "offset") -> Column:
    """Offsets from start to end, both included, of each partition."""
    parts = b.parsed(BoundaryMode.OFFSET_RANGE).get("partitions")
    try:
        cases = [(F.col(partition) == int(p["id"])) & F.col(offset).between(int(p["start"]), int(p["end"])) for p in parts]
    except (KeyError, TypeError, ValueError) as e:
        raise InvalidBoundary(f"no list of partitions with id, start and end: {e}") from e
    return reduce(lambda x, y: x | y, cases, F.lit(False)) if cases else F.lit(False)


def snapshot_range(b: Boundary, column: str = "snapshot_id") -> Column:
    """Snapshots from snapshot_from to snapshot_to, both included; or a batch_id."""
    d = b.parsed(BoundaryMode.BATCH_ID)
    if "batch_id" in d:
        return F.col(column) == d["batch_id"]
    try:
        return F.col(column).between(int(d["snapshot_from"]), int(d["snapshot_to"]))
    except (KeyError, TypeError, ValueError) as e:
        raise InvalidBoundary(f"no snapshot_from and snapshot_to: {e}") from e


def time_window(b: Boundary, column: str = "ts") -> Column:
    """From start up to, but without, end; UTC."""
    d = b.parsed(BoundaryMode.TIME_WINDOW)
    if not d.get("start") or not d.get("end"):
        raise InvalidBoundary("no start and end")
    return (F.col(column) >= F.lit(d["start"]).cast("timestamp_ntz")) & (F.col(column) < F.lit(d["end"]).cast("timestamp_ntz"))


def bounded(df: DataFrame, b: Boundary, **columns: str) -> DataFrame:
    return df.where({BoundaryMode.OFFSET_RANGE: offset_range, BoundaryMode.BATCH_ID: snapshot_range, BoundaryMode.TIME_WINDOW: time_window}[b.mode](b, **columns))


def max_messages(df: DataFrame, b: Boundary) -> DataFrame:
    n = b.parsed().get("max_messages")
    if not isinstance(n, int) or n < 0:
        raise InvalidBoundary("no max_messages")
    return df.limit(n)


def sql_filter(df: DataFrame, condition: str | None) -> DataFrame:
    return df.where(F.expr(condition)) if condition else df
