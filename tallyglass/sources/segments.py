"""A log in segments, read by ranges of offsets: partition, offset and value, as a Python data source for batches and streams.

Segments are Parquet files under partition=P/segment=S, where S is the offset divided
by the segment's length, so a boundary names its folders without a listing. Each
task reads one range of one partition's segments and gives Arrow batches; a task that
is lost reads its own range again. Conditions on partition and offset reach the reader
and decide which ranges there are. Offsets that no segment has are
not an error here: `completeness` finds them.

Scale: the driver plans from the boundary, or from the names of each partition's
segments where it has none; it opens no file, but for the last segment of each partition of
a stream. A task holds one batch at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions.model import Boundary, BoundaryMode, ConnectorError, InvalidBoundary

SCHEMA = "partition long, offset long, value binary"
#: Offsets of a segment, and segments that one task reads.
SEGMENT, TASK = 100_000, 4
_BATCH = 8_192
#: Tasks of one partition from which its segments' names are asked first.
_FAR = 1 << 16
_NO_END = (1 << 63) - 1


@dataclass
class Range(InputPartition):
    """Offsets first to last (both included) of a partition."""

    partition: int
    first: int
    last: int


def write_segments(log: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes (partition, offset, value) as segments; a row without partition or offset is an error. An empty log makes an empty folder."""
    rows = log.select(*(F.coalesce(F.col(c).cast("long"), F.raise_error(F.lit(f"a row without {c}")).cast("long")).alias(c) for c in ("partition", "offset")), F.col("value").cast("binary").alias("value"))
    rows = rows.withColumn("segment", F.floor(F.col("offset") / segment))
    rows.repartition("partition", "segment").sortWithinPartitions("partition", "segment", "offset").write.partitionBy("partition", "segment").parquet(path)


class _Segments:
    """The folders of a log on any file system that pyarrow knows."""

    def __init__(self, options: dict[str, str]):
        self.path, self.segment, self.task = options["path"], int(options.get("segment", SEGMENT)), int(options.get("task", TASK))
        if self.segment < 1 or self.task < 1:
            raise ConnectorError("segment and task have to be 1 or more")
        self.wanted = parsed(options["boundary"]) if options.get("boundary") else None

    def opened(self):
        from pyarrow import fs

        for a, b in (("s3a://", "s3://"), ("file:///", "/")):
            if self.path.startswith(a):
                return fs.FileSystem.from_uri(b + self.path[len(a) :])
        return fs.FileSystem.from_uri(self.path)

    def numbers(self, folder: str, name: str) -> list[int]:
        from pyarrow import fs

        system, root = self.opened()
        found = system.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted(int(f.base_name.split("=")[1]) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(name + "="))

    def bounds(self) -> dict[int, tuple[int, int]]:
        """First and last offset of each partition: the boundary's, else (or where its end is that far) those that its segments' names allow."""
        out = {}
        for p in self.numbers("", "partition") if self.wanted is None else self.wanted:
            first, last = (0, _NO_END) if self.wanted is None else self.wanted[p]
            if (last - first) // (self.segment * self.task) >= _FAR and (s := self.numbers(f"partition={p}", "segment")):
                first, last = max(first, s[0] * self.segment), min(last, (s[-1] + 1) * self.segment - 1)
            elif (last - first) // (self.segment * self.task) >= _FAR:
                last = first - 1
            out[p] = first, last
        return out

    def ranges(self, bounds: dict[int, tuple[int, int]]) -> list[Range]:
        """Ranges that end where a task's segments do."""
        step, out = self.segment * self.task, []
        for p, (first, last) in sorted(bounds.items()):
            for lo in range(first - first % step, last + 1, step):
                out.append(Range(p, max(first, lo), min(last, lo + step - 1)))
        return out

    def files(self, partition: int, segment: int) -> tuple:
        from pyarrow import fs

        system, root = self.opened()
        found = system.get_file_info(fs.FileSelector(f"{root}/partition={partition}/segment={segment}", allow_not_found=True))
        return system, sorted(f.path for f in found if f.path.endswith(".parquet"))

    def batches(self, r: Range) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds

        for s in range(r.first // self.segment, r.last // self.segment + 1):
            system, files = self.files(r.partition, s)
            if files:
                part = ds.dataset(files, filesystem=system, format="parquet", schema=pa.schema([("offset", pa.int64()), ("value", pa.binary())]))
                for b in part.to_batches(filter=(ds.field("offset") >= r.first) & (ds.field("offset") <= r.last), batch_size=_BATCH, batch_readahead=1, fragment_readahead=1):
                    yield pa.record_batch([pa.repeat(pa.scalar(r.partition, pa.int64()), len(b)), b.column(0), b.column(1)], names=["partition", "offset", "value"])

    def next_offset(self, partition: int) -> int:
        """One more than the partition's last offset."""
        import pyarrow.parquet as pq

        for s in reversed(self.numbers(f"partition={partition}", "segment")):
            system, files = self.files(partition, s)
            last = []
            for f in files:
                meta = pq.ParquetFile(f, filesystem=system)
                last += [meta.metadata.row_group(i).column(meta.schema_arrow.get_field_index("offset")).statistics.max for i in range(meta.metadata.num_row_groups)]
            if last:
                return max(last) + 1
        return 0


def parsed(boundary: str) -> dict[int, tuple[int, int]]:
    try:
        rows = [(int(p["id"]), int(p["start"]), int(p["end"])) for p in json.loads(boundary)]
    except (KeyError, TypeError, ValueError) as e:
        raise InvalidBoundary(f"no list of partitions with id, start and end: {e}") from e
    if len({r[0] for r in rows}) < len(rows) or any(r[1] < 0 for r in rows):
        raise InvalidBoundary("a partition is listed twice or begins before 0")
    return {p: (a, z) for p, a, z in rows}


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.log = _Segments(options)
        self.only: set[int] | None = None
        self.low, self.high = {"partition": 0, "offset": 0}, {"partition": _NO_END, "offset": _NO_END}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of partition and offset with numbers, which ranges fulfil exactly; gives back all others."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) in (("partition",), ("offset",)) else None
            v = getattr(f, "value", None)
            if column is None:
                yield f
            elif isinstance(f, IsNotNull):
                pass
            elif isinstance(f, In) and column == "partition":
                found = {x for x in v if x is not None}
                self.only = found if self.only is None else self.only & found
            elif isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan | LessThanOrEqual | LessThan) and isinstance(v, int):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.low[column] = max(self.low[column], v + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.high[column] = min(self.high[column], v - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fits = lambda p: self.low["partition"] <= p <= self.high["partition"] and (self.only is None or p in self.only)
        bounds = {p: (max(a, self.low["offset"]), min(z, self.high["offset"])) for p, (a, z) in self.log.bounds().items() if fits(p)}
        return self.log.ranges(bounds) or [Range(0, 0, -1)]

    def read(self, partition: Range) -> Iterator:
        if partition.first <= partition.last:
            yield from self.log.batches(partition)


class _Stream(DataSourceStreamReader):
    """The position is the next offset of each partition, as text; partitions and offsets that appear later are read later, up to the boundary's end."""

    def __init__(self, options: dict[str, str]):
        self.log = _Segments(options)

    def initialOffset(self) -> dict:
        return {str(p): a for p, (a, _) in (self.log.wanted or {}).items()}

    def latestOffset(self) -> dict:
        if self.log.wanted is None:
            return {str(p): self.log.next_offset(p) for p in self.log.numbers("", "partition")}
        return {str(p): max(a, min(self.log.next_offset(p), z + 1)) for p, (a, z) in self.log.wanted.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.log.ranges({int(p): (start.get(p, 0), e - 1) for p, e in end.items()})

    def read(self, partition: Range) -> Iterator:
        yield from self.log.batches(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: segments stay."""


class Segments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def read_segments(spark: SparkSession, path: str, boundary: Boundary | None = None, segment: int = SEGMENT, task: int = TASK, stream: bool = False) -> DataFrame:
    """(partition, offset, value) of a log's segments within a boundary (both ends included; all without one), as a batch or a stream.

    The segment's length has to be the writer's. Partitions and segments that aren't there
    give no rows. Turns on the session's push-down of filters into Python sources.
    """
    spark.dataSource.register(Segments)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "segment": str(segment), "task": str(task)}
    if boundary is not None:
        options["boundary"] = json.dumps(boundary.parsed(BoundaryMode.OFFSET_RANGE).get("partitions"))
        parsed(options["boundary"])
    return (spark.readStream if stream else spark.read).format("log_segments").options(**options).load()
