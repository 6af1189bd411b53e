"""Tables with a Delta log, read at any version: the log is replayed as an aggregation, files are skipped by their statistics.

Of the log, the last whole checkpoint up to the version and the commits after it are
read. The last action on a path decides whether its file belongs to the version; that
is one group for each path, so the replay is one exchange of the log, not of the
data. Statistics are compared in the same plan, before any file's name leaves it.

Scale: the driver lists the log's folder and gets the names of the files that are
left, as every scan's own index of files holds them. Partition values are in the log
only; they are joined to the rows by the file's name, and broadcast, since there is one
row for each name that the driver holds. A table without partitions isn't joined.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model import Boundary, BoundaryMode, ConnectorError, InvalidBoundary
from .stores import Files

# The log's folder, file names and the fields of its actions that are read.
LOG = "_delta_log"
_COMMIT, _CHECKPOINT = re.compile(r"(\d{20})\.json"), re.compile(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet")
ACTIONS = """
 add struct<path:string,partitionValues:map<string,string>,size:long,modificationTime:long,dataChange:boolean,stats:string,deletionVector:struct<storageType:string,pathOrInlineDv:string>>,
 remove struct<path:string,deletionTimestamp:long,dataChange:boolean>,
 metaData struct<id:string,format:struct<provider:string,options:map<string,string>>,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>,
 protocol struct<minReaderVersion:int,minWriterVersion:int,readerFeatures:array<string>>"""
#: Features that change how the table is read. One that allows deletion vectors may have none: files that carry one are refused.
_UNREAD = {"columnMapping", "v2Checkpoint"}
_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BooleanType)


@dataclass
class DeltaTable:
    """A table under a folder that Spark can reach. Deletion vectors, column mapping and checkpoints of version 2 are errors, never wrong rows."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.store = Files(self.spark, self.path)
        self.base = self.store.root

    def ref(self) -> str:
        return f"delta:{self.base}"

    # --- the log ---

    def _listed(self) -> tuple[dict[int, str], dict[int, dict[int, list[str]]]]:
        """Commits by version; checkpoints by version and number of parts."""
        if not self.store.exists(LOG):
            raise ConnectorError(f"no log under {self.base}")
        commits: dict[int, str] = {}
        checkpoints: dict[int, dict[int, list[str]]] = {}
        for s in self.store.fs.listStatus(self.store.path(LOG)):
            name = s.getPath().getName()
            if m := _COMMIT.fullmatch(name):
                commits[int(m[1])] = name
            elif m := _CHECKPOINT.fullmatch(name):
                checkpoints.setdefault(int(m[1]), {}).setdefault(int(m[3] or 1), []).append(name)
        return commits, checkpoints

    def latest(self) -> int:
        commits, checkpoints = self._listed()
        if not commits and not checkpoints:
            raise ConnectorError(f"an empty log under {self.base}")
        return max([*commits, *checkpoints])

    def actions(self, version: int | None = None) -> DataFrame:
        """The log's actions that make up a version, each with its own version; those of a checkpoint have the checkpoint's."""
        commits, checkpoints = self._listed()
        version = self.latest() if version is None else version
        whole = [(v, names) for v, sets in checkpoints.items() if v <= version for parts, names in sets.items() if len(names) == parts]
        start, names = max(whole, default=(-1, []))
        wanted = range(start + 1, version + 1)
        if lost := [v for v in wanted if v not in commits]:
            raise ConnectorError(f"version {version} can't be read: the log lacks version {lost[0]}")
        at = f"{self.base}/{LOG}"
        read = self.spark.read.schema(ACTIONS)
        number = F.substring(F.col("_metadata.file_name"), 1, 20).cast("long").alias("version")
        parts = []
        if names:
            parts.append(read.parquet(*(f"{at}/{n}" for n in names)).select("*", number))
        if wanted:
            parts.append(read.json([f"{at}/{commits[v]}" for v in wanted]).select("*", number))
        if not parts:
            raise ConnectorError(f"no version {version} under {self.base}")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def schema(self, version: int | None = None) -> tuple[T.StructType, list[str]]:
        """The version's columns and which of them are partitions."""
        r = self.actions(version).agg(F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("meta"), F.max_by("protocol", F.when(F.col("protocol").isNotNull(), F.col("version"))).alias("protocol")).first()
        if r.meta is None:
            raise ConnectorError(f"the log under {self.base} has no metadata")
        mapping = (r.meta.configuration or {}).get("delta.columnMapping.mode", "none")
        unread = set((r.protocol.readerFeatures if r.protocol else None) or []) & _UNREAD | ({"columnMapping"} if mapping != "none" else set())
        if "v2Checkpoint" in unread or mapping != "none":
            raise ConnectorError(f"not read: {', '.join(sorted(unread))}")
        return T.StructType.fromJson(json.loads(r.meta.schemaString)), list(r.meta.partitionColumns or [])

    def files(self, version: int | None = None, ranges: dict[str, tuple[Any, Any]] | None = None) -> DataFrame:
        """(path, partition_values, size, stats) of the version's files; with ranges (column: least and greatest, either may be None), only of those that can hold rows within all of them.

        A file without a statistic is never skipped by it. A file whose rows of a column are all null is outside of that column's range.
        """
        x = self.actions(version)
        path = F.coalesce("add.path", "remove.path")
        # an add wins over a remove of the same commit
        last = x.where(path.isNotNull()).groupBy(path.alias("path")).agg(F.max_by("add", F.struct("version", F.col("add").isNotNull())).alias("add")).where("add is not null")
        vector = F.when(F.col("add.deletionVector").isNotNull(), F.raise_error(F.concat(F.lit("a file with a deletion vector: "), F.col("path"))).cast("string"))
        out = last.select(F.coalesce(vector, F.col("path")).alias("path"), F.col("add.partitionValues").alias("partition_values"), F.col("add.size").alias("size"), F.col("add.stats").alias("stats"))
        if not ranges:
            return out
        schema, partitions = self.schema(version)
        if unknown := set(ranges) - set(schema.fieldNames()):
            raise InvalidBoundary(f"no such column: {', '.join(sorted(unknown))}")
        inside = [f for f in schema if f.name in ranges and f.name not in partitions and isinstance(f.dataType, _ORDERED)]
        ends = T.StructType([T.StructField(f.name, f.dataType) for f in inside])
        stats = T.StructType([T.StructField("numRecords", T.LongType()), T.StructField("minValues", ends), T.StructField("maxValues", ends), T.StructField("nullCount", T.StructType([T.StructField(f.name, T.LongType()) for f in inside]))])
        out = out.withColumn("__s", F.from_json("stats", stats))
        keep: Column = F.lit(True)
        for f in inside:
            lo, hi = F.col(f"__s.minValues.`{f.name}`"), F.col(f"__s.maxValues.`{f.name}`")
            if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):  # statistics end at milliseconds
                hi = hi + F.expr("interval 1 millisecond")
            keep = keep & _may(lo, hi, *ranges[f.name]) & F.coalesce(F.col(f"__s.nullCount.`{f.name}`") < F.col("__s.numRecords"), F.lit(True))
        for f in (f for f in schema if f.name in ranges and f.name in partitions):
            v = _partition_value(F.col("partition_values"), f)
            keep = keep & _may(v, v, *ranges[f.name]) & v.isNotNull()
        return out.where(keep).drop("__s")

    # --- the rows ---

    def read(self, version: int | None = None, ranges: dict[str, tuple[Any, Any]] | None = None) -> DataFrame:
        """The version's rows, within the ranges, with pos (file and row of the file) and pos_text. A table without rows gives its columns. Columns named pos or pos_text are replaced."""
        schema, partitions = self.schema(version)
        names = [r.path for r in self.files(version, ranges).select("path").collect()]
        data = T.StructType([f for f in schema if f.name not in partitions])
        if not names:
            empty = self.spark.createDataFrame([], schema)
            at = F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("row"))
            return empty.withColumns({"pos": at, "pos_text": F.to_json(at)})
        if outside := next((n for n in names if "://" in n or n.startswith("/")), None):
            raise ConnectorError(f"a file outside of the table's folder: {outside}")
        decoded = [_decoded(n) for n in names]
        folder = self.store.path("").toUri().getPath().rstrip("/") + "/"
        full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        file = F.substring(full, F.instr(full, folder) + len(folder), F.length(full))
        x = self.spark.read.schema(data).option("recursiveFileLookup", True).parquet(*(f"{self.base}/{n}" for n in decoded))
        x = x.select(*(F.col(f"`{f.name}`") for f in data if f.name not in ("pos", "pos_text")), F.struct(file.alias("file"), F.col("_metadata.row_index").alias("row")).alias("pos"))
        if partitions:
            values = self.files(version, ranges)
            path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
            values = values.select(path.alias("__file"), *(_partition_value(F.col("partition_values"), f).alias(f.name) for f in schema if f.name in partitions))
            x = x.join(F.broadcast(values), F.col("pos.file") == F.col("__file")).drop("__file")  # one row for each name that the driver holds
        for column, (lo, hi) in (ranges or {}).items():
            c = F.col(f"`{column}`")
            x = x.where(c.isNotNull()) if lo is None and hi is None else x.where((c >= lo if lo is not None else F.lit(True)) & (c <= hi if hi is not None else F.lit(True)))
        columns = [F.col(f"`{f.name}`") for f in schema if f.name not in ("pos", "pos_text")]
        return x.select(*columns, "pos", F.to_json("pos").alias("pos_text"))

    def rows(self, boundary: Boundary | None = None) -> DataFrame:
        """The rows of the version that a boundary's snapshot_to names; its snapshot_from has to be 0 or the same, as checkpoints don't say which version added a file."""
        if boundary is None:
            return self.read()
        b = boundary.parsed(BoundaryMode.BATCH_ID)
        try:
            first, last = int(b["snapshot_from"]), int(b["snapshot_to"])
        except (KeyError, TypeError, ValueError) as e:
            raise InvalidBoundary(f"no snapshot_from and snapshot_to: {e}") from e
        if first not in (0, last):
            raise InvalidBoundary("a log's versions are states: snapshot_from is 0 or snapshot_to")
        return self.read(last)

    def field_names(self) -> list[str]:
        return self.schema()[0].fieldNames()

    # --- writing ---

    def commit(self, add: DataFrame | None = None, remove: DataFrame | None = None, partition_by: tuple[str, ...] = ()) -> int:
        """Writes a version that adds the rows of add and removes the files of remove (a frame with path, as of files()); returns its number.

        The first version fixes the columns. Another writer's commit of the same number is
        an error, and this one's files then belong to no version.
        """
        new = not self.store.exists(LOG)
        version = 0 if new else self.latest() + 1
        lines: list[str] = []
        if new:
            if add is None:
                raise ConnectorError("the first version needs rows, for their columns")
            meta = {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": add.schema.json(), "partitionColumns": list(partition_by), "configuration": {}}
            lines += [json.dumps({"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}), json.dumps({"metaData": meta})]
        elif add is not None:
            schema, partitions = self.schema()
            if [(f.name, f.dataType) for f in add.schema] != [(f.name, f.dataType) for f in schema]:
                raise ConnectorError("the rows have other columns than the table")
            partition_by = tuple(partitions)
        if remove is not None:
            lines += [json.dumps({"remove": {"path": r.path, "deletionTimestamp": 0, "dataChange": True}}) for r in remove.select("path").collect()]
        if add is not None:
            lines += self._written(add, partition_by)
        self.store.create(f"{LOG}/{version:020d}.json", "\n".join([*lines, ""]).encode())
        return version

    def _written(self, add: DataFrame, partition_by: tuple[str, ...]) -> list[str]:
        """The add actions of rows that are written to a new folder, one for each file."""
        folder = f"part-{uuid.uuid4().hex}"
        add.write.partitionBy(*partition_by).parquet(f"{self.base}/{folder}")
        x = self.spark.read.schema(add.schema).parquet(f"{self.base}/{folder}")
        ordered = [f for f in add.schema if f.name not in partition_by and isinstance(f.dataType, _ORDERED)]
        c = {f.name: F.col(f"`{f.name}`") for f in add.schema}
        ends = lambda of: F.struct(*(of(c[f.name]).alias(f.name) for f in ordered))
        stats = F.struct(F.count("*").alias("numRecords"), *([ends(F.min).alias("minValues"), ends(F.max).alias("maxValues"), ends(lambda v: F.count("*") - F.count(v)).alias("nullCount")] if ordered else []))
        values = F.map_from_arrays(F.array(*map(F.lit, partition_by)), F.array(*(c[p].cast("string") for p in partition_by))) if partition_by else F.create_map().cast("map<string,string>")
        per = x.groupBy("_metadata.file_path", "_metadata.file_size", F.to_json(values).alias("values")).agg(F.to_json(stats).alias("stats"))
        out = []
        for r in per.orderBy("file_path").collect():
            path = f"{folder}/" + r.file_path.split(f"/{folder}/", 1)[1]
            out.append(json.dumps({"add": {"path": path, "partitionValues": dict.fromkeys(partition_by) | json.loads(r["values"]), "size": r.file_size, "modificationTime": 0, "dataChange": True, "stats": r.stats}}))
        return out

    def checkpoint(self) -> int:
        """Writes the latest version's files, columns and protocol as a checkpoint; versions before it stay readable while their commits are there."""
        version = self.latest()
        x = self.actions(version)
        none = {f.name: F.lit(None).cast(f.dataType) for f in x.drop("version").schema}
        path = F.coalesce("add.path", "remove.path")
        adds = x.where(path.isNotNull()).groupBy(path.alias("path")).agg(F.max_by("add", F.struct("version", F.col("add").isNotNull())).alias("add")).where("add is not null")
        one = x.agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in ("metaData", "protocol")))
        rows = adds.select(*((F.col("add") if n == "add" else v).alias(n) for n, v in none.items()))
        for c in ("metaData", "protocol"):
            rows = rows.unionByName(one.select(*((F.col(c) if n == c else v).alias(n) for n, v in none.items())))
        part = f"{LOG}/_{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.base}/{part}")
        file = next(s.getPath() for s in self.store.fs.listStatus(self.store.path(part)) if s.getPath().getName().startswith("part-"))
        if not self.store.fs.rename(file, self.store.path(f"{LOG}/{version:020d}.checkpoint.parquet")):
            raise ConnectorError(f"version {version} has a checkpoint")
        self.store.fs.delete(self.store.path(part), True)
        return version


def _decoded(path: str) -> str:
    from urllib.parse import unquote

    return unquote(path)


def _may(lo: Column, hi: Column, least: Any, greatest: Any) -> Column:
    """Whether values between lo and hi can be within least and greatest; unknown ends can."""
    yes = F.lit(True)
    low = F.coalesce(lo <= F.lit(greatest), yes) if greatest is not None else yes
    return low & (F.coalesce(hi >= F.lit(least), yes) if least is not None else yes)


def _partition_value(values: Column, f: T.StructField) -> Column:
    """A partition's value from its text; an empty text is null."""
    return F.nullif(F.get(F.map_values(F.map_filter(values, lambda k, _: k == f.name)), F.lit(0)), F.lit("")).cast(f.dataType)
