"""Sources and sinks: rows of a boundary with their position, as DataFrames.

Fingerprinting is one transform for all of them, so a connector only says which
rows there are. Projection and predicates are Catalyst's to push down;
pushed_down() reads from the physical plan whether they were.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import fingerprints
from ..functions.model import Boundary, BoundaryMode, ConnectorError, InvalidBoundary, Policy
from .boundary import bounded, offset_range, snapshot_range
from .delta import DeltaTable
from .stores import Files


class Connector(Protocol):
    def ref(self) -> str: ...

    def rows(self, boundary: Boundary) -> DataFrame:
        """Records in the boundary, with pos (numbers that order them) and pos_text."""
        ...

    def field_names(self) -> list[str]: ...


def fingerprint_boundary(c: Connector, boundary: Boundary, policy: Policy, salt: bytes) -> DataFrame:
    return fingerprints(c.rows(boundary), policy, salt)


@dataclass(frozen=True)
class SinkBatch:
    """Fingerprints of a sink, and whether its scan was cut to the columns that are hashed."""

    fingerprints: DataFrame
    pushdown_used: bool


def fingerprint_sink(c: Connector, boundary: Boundary, policy: Policy, salt: bytes) -> SinkBatch:
    rows = c.rows(boundary)
    fps = fingerprints(rows, policy, salt)
    return SinkBatch(fps, pushed_down(fps, [*policy.identity, *policy.effective]))


def pushed_down(df: DataFrame, columns: list[str]) -> bool:
    """Whether the scans read no more than these columns; False where the plan says nothing of what they read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    return bool(schemas) and all({x.split(":")[0] for x in s.split(",") if x and not x.startswith("_tmp_metadata_")} <= set(columns) for s in schemas)


def parse_payload(log: DataFrame, schema: str | T.StructType, value: str = "value") -> DataFrame:
    """JSON objects as columns; anything else is an error."""
    return log.withColumn("__r", F.from_json(F.col(value).cast("string"), schema, {"mode": "FAILFAST"})).select(*[c for c in log.columns if c != value], "__r.*")


#: Null fields of nested objects are left out by the untyped form; numbers are decimals, as text.
def payload_fields(value: str, names: list[str]) -> list:
    """Top-level fields of a JSON payload as strings that keep their type: numbers as dec: text, exactly as written."""
    out = []
    for n in names:
        raw = F.get_json_object(F.col(value).cast("string"), f"$.{n}")
        number = F.col(value).cast("string").rlike(rf'"{n}"\s*:\s*-?[0-9]')
        out.append(F.when(number, F.concat(F.lit("dec:"), raw)).otherwise(raw).alias(n))
    return out


@dataclass
class KafkaLog:
    """A log as a table of partition, offset and value; what a topic looks like once it is read."""

    log: DataFrame
    schema: str | T.StructType
    name: str = "memory"

    def ref(self) -> str:
        return f"kafka:{self.name}"

    def produce(self, rows: DataFrame) -> KafkaLog:
        """Later rows replace those at the same partition and offset."""
        x = self.log.withColumn("__n", F.lit(0)).unionByName(rows.withColumn("__n", F.lit(1)))
        return KafkaLog(x.groupBy("partition", "offset").agg(F.max_by("value", "__n").alias("value")), self.schema, self.name)

    def payloads(self, b: Boundary) -> DataFrame:
        return self.log.where(offset_range(b)).select("partition", "offset", "value")

    def rows(self, boundary: Boundary) -> DataFrame:
        x = parse_payload(self.payloads(boundary), self.schema)
        at = F.struct(F.col("partition").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("offset").cast("long").alias("c"))
        return x.withColumns({"pos": at, "pos_text": F.to_json(F.struct("offset", "partition"))}).drop("partition", "offset")

    def field_names(self) -> list[str]:
        return self.schema.fieldNames() if isinstance(self.schema, T.StructType) else T.StructType.fromDDL(self.schema).fieldNames()


def kafka_source(spark: SparkSession, bootstrap: str, topic: str, schema: str, boundary: Boundary, security: dict[str, str] | None = None) -> KafkaLog:
    """A topic's boundary by Spark's Kafka source; its end is exclusive, ours inclusive. Lost data is an error."""
    parts = boundary.parsed(BoundaryMode.OFFSET_RANGE)["partitions"]
    o = {"kafka.bootstrap.servers": bootstrap, "assign": json.dumps({topic: [p["id"] for p in parts]}), "failOnDataLoss": "true", "startingOffsets": json.dumps({topic: {str(p["id"]): p["start"] for p in parts}}), "endingOffsets": json.dumps({topic: {str(p["id"]): p["end"] + 1 for p in parts}})}
    try:
        return KafkaLog(spark.read.format("kafka").options(**o, **(security or {})).load().select("partition", "offset", "value"), schema, topic)
    except Exception as e:
        raise ConnectorError(f"the Kafka source is not available: {e}") from e


def msk_security(region: str) -> dict[str, str]:
    return {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "OAUTHBEARER", "kafka.sasl.oauthbearer.config": f"region={region}"}


def eventhubs_security(connection: str) -> dict[str, str]:
    login = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="$ConnectionString" password="{connection}";'
    return {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login}


@dataclass
class SnapshotTable:
    """Parquet files listed by metadata/snapshots.json under a root that Spark can reach (file, s3a, abfss, gs)."""

    spark: SparkSession
    root: str
    table: str

    @property
    def base(self) -> str:
        return f"{self.root.rstrip('/')}/{self.table}"

    def ref(self) -> str:
        return f"iceberg:{self.base}"

    def snapshots(self) -> DataFrame:
        return self.spark.read.schema("snapshot_id long, files array<string>").option("multiLine", True).json(f"{self.base}/metadata/snapshots.json")

    def snapshot_ids(self) -> list[int]:
        return [x["snapshot_id"] for x in json.loads(store.read("metadata/snapshots.json"))] if (store := Files(self.spark, self.base)).exists("metadata/snapshots.json") else []

    def write_snapshot(self, df: DataFrame, snapshot_id: int) -> None:
        """Writes the rows and adds the snapshot to the list; the list has as many entries as snapshots."""
        path = f"data/snap-{snapshot_id}"
        df.write.parquet(f"{self.base}/{path}")
        files = [f"{path}/{f.rsplit('/', 1)[1]}" for f in self.spark.read.parquet(f"{self.base}/{path}").inputFiles()]
        store = Files(self.spark, self.base)
        old = json.loads(store.read("metadata/snapshots.json")) if store.exists("metadata/snapshots.json") else []
        store.write("metadata/snapshots.json", json.dumps([*old, {"snapshot_id": snapshot_id, "files": sorted(files)}]).encode())

    def rows(self, boundary: Boundary) -> DataFrame:
        """Rows of the snapshots in the range; only their files are read. pos is snapshot, file and row in the file. A file of the list that a row can't be told to be of is an error."""
        chosen = self.snapshots().where(snapshot_range(boundary)).select("snapshot_id", F.posexplode("files").alias("file_index", "file"))
        files = chosen.collect()  # one row per file of the chosen snapshots, as a scan lists them anyway
        if not files:
            raise InvalidBoundary("no snapshot in the boundary")
        data = self.spark.read.parquet(*[f"{self.base}/{f.file}" for f in files])
        names = self.spark.createDataFrame([(f.snapshot_id, f.file_index, f.file) for f in files], "snapshot_id long, file_index long, file string")
        # files are told by the end of their paths; paths come URL-encoded
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        x = data.select("*", F.substring_index(path, f"/{self.table}/", -1).alias("__f"), F.col("_metadata.row_index").alias("row_index"))
        x = x.join(F.broadcast(names.withColumnRenamed("file", "__f")), "__f", "left")  # one row a file, as the scan's own list has
        x = x.withColumn("snapshot_id", F.coalesce("snapshot_id", F.raise_error(F.concat(F.lit("no snapshot lists the file "), F.col("__f"))).cast("long"))).drop("__f")
        at = F.struct(F.col("snapshot_id").alias("a"), F.col("file_index").alias("b"), F.col("row_index").alias("c"))
        return x.withColumns({"pos": at, "pos_text": F.to_json(F.struct("file_index", "row_index", "snapshot_id"))}).drop("snapshot_id", "file_index", "row_index")

    def field_names(self) -> list[str]:
        first = self.snapshots().orderBy("snapshot_id").select(F.get("files", F.lit(0)).alias("f")).first()
        return self.spark.read.parquet(f"{self.base}/{first.f}").columns


@dataclass
class TableRows:
    """Any table or DataFrame, with the columns that order it."""

    df: DataFrame
    order: tuple[str, ...]
    name: str = "table"

    def ref(self) -> str:
        return f"table:{self.name}"

    def rows(self, boundary: Boundary | None = None) -> DataFrame:
        x = self.df if boundary is None else bounded(self.df, boundary)
        return x.withColumns({"pos": F.struct(*self.order), "pos_text": F.to_json(F.struct(*self.order))})

    def field_names(self) -> list[str]:
        return self.df.columns


def row_hash(df: DataFrame, fields: list[str], condition: str | None = None) -> DataFrame:
    """row_hash: SHA-256 of the fields' texts, joined by bars; the form that warehouses can compute themselves."""
    x = df.where(F.expr(condition)) if condition else df
    return x.withColumn("row_hash", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256))


def row_hash_sql(table: str, fields: list[str], condition: str | None = None) -> str:
    parts = ", '|', ".join(f"COALESCE(CAST({f} AS STRING), '')" for f in fields)
    return f"SELECT TO_HEX(SHA256(CONCAT({parts}))) AS row_hash FROM `{table}`" + (f" WHERE {condition}" if condition else "")


def kafka_position(offset: Column) -> Column:
    """An offset as 8 bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(offset.cast("long")), 16, "0"))


def bigquery_rows(spark: SparkSession, table: str, condition: str | None = None, **options: str) -> TableRows:
    """A warehouse table by the BigQuery connector, with the filter pushed down; an error where the connector isn't installed."""
    try:
        x = spark.read.format("bigquery").options(**options)
        df = (x.option("filter", condition) if condition else x).load(table)
        return TableRows(df, tuple(df.columns), table)
    except Exception as e:
        raise ConnectorError(f"the BigQuery connector is not available: {e}") from e


def _kafka(spark: SparkSession, c: dict, boundary: Boundary, schema: str) -> KafkaLog:
    kind = c["type"]
    security = msk_security(c.get("region") or "") if kind == "msk" else eventhubs_security(c.get("connection_string") or "") if kind == "eventhubs" else None
    if not c.get("bootstrap_servers"):
        raise ConnectorError(f"{kind} needs bootstrap_servers")
    return kafka_source(spark, c["bootstrap_servers"], c["topic"], schema, boundary, security)


def _memory(spark: SparkSession, c: dict, boundary: Boundary, schema: str) -> KafkaLog:
    return KafkaLog(spark.createDataFrame([], "partition int, offset long, value binary"), schema, c["topic"])


def _pubsub(spark: SparkSession, c: dict, boundary: Boundary, schema: str) -> KafkaLog:
    from .pubsub import pull

    return KafkaLog(pull(spark, c["project"], c["subscription"], boundary), schema, c["subscription"])


def _snapshots(spark: SparkSession, c: dict) -> SnapshotTable:
    root = c.get("warehouse_uri") or c.get("warehouse")
    if not root:
        raise ConnectorError(f"{c['type']} needs a warehouse")
    root = root if "://" in root else "file://" + os.path.abspath(root)
    return SnapshotTable(spark, root.replace("s3://", "s3a://", 1), c["table"])


def _delta(spark: SparkSession, c: dict) -> DeltaTable:
    root = c.get("warehouse_uri") or c.get("warehouse")
    if not root:
        raise ConnectorError(f"{c['type']} needs a warehouse")
    root = root if "://" in root else "file://" + os.path.abspath(root)
    return DeltaTable(spark, f"{root.replace('s3://', 's3a://', 1).rstrip('/')}/{c['table']}")


def _catalog(spark: SparkSession, c: dict) -> TableRows:
    name = ".".join(x for x in (c.get("catalog"), c.get("schema"), c["table"]) if x)
    df = spark.table(name)
    return TableRows(df.where(F.expr(f)) if (f := c.get("boundary", {}).get("sql_filter")) else df, tuple(df.columns), name)


def _warehouse(spark: SparkSession, c: dict) -> TableRows:
    return bigquery_rows(spark, ".".join(x for x in (c.get("dataset"), c["table"]) if x), c.get("boundary", {}).get("sql_filter"))


#: What a configuration can name: source makers take its section, the boundary and the payload's schema, sink makers its section.
SOURCES = {"memory_kafka": _memory, "kafka": _kafka, "msk": _kafka, "eventhubs": _kafka, "pubsub": _pubsub}
SINKS = {"iceberg": _snapshots, "iceberg_s3": _snapshots, "iceberg-s3": _snapshots, "delta_adls": _snapshots, "delta": _delta, "bigquery": _warehouse, "databricks": _catalog, "databricks_delta": _catalog, "table": _catalog}


def build_source(spark: SparkSession, section: dict, boundary: Boundary, schema: str) -> Connector:
    if section.get("type") not in SOURCES:
        raise ConnectorError(f"unknown source: {section.get('type')}")
    return SOURCES[section["type"]](spark, section, boundary, schema)


def build_sink(spark: SparkSession, section: dict) -> Connector:
    if section.get("type") not in SINKS:
        raise ConnectorError(f"unknown sink: {section.get('type')}")
    return SINKS[section["type"]](spark, section)
