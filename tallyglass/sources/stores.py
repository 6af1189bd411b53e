"""Files on any file system that Spark's Hadoop client reaches (local, s3a, gs, abfss), and the store of documents on them."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import ConnectorError


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under the one that spark.checkpoint.dir names; without that, a temporary folder, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ConnectorError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.root = root.rstrip("/") if "://" in root else "file://" + os.path.abspath(root)
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> str:
        """Replaces the file as one step: readers find the old or the new content, also after a crash."""
        part = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(part, self.path(name), options)
        return f"{self.root}/{name}"

    def create(self, name: str, data: bytes) -> str:
        """Writes a new file as one step; one that is there already is an error."""
        part, at = self.path(f"{name}.{uuid.uuid4().hex}.tmp"), self.path(name)
        self.fs.mkdirs(at.getParent())
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(part, at, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(part, False)
            raise ConnectorError(f"not written: {name} may be there already: {e}") from e
        return f"{self.root}/{name}"

    def newest(self, suffix: str) -> str | None:
        """The name of the file changed last, ties to the last name."""
        if not self.exists(""):
            return None
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self.fs.listStatus(self.path("")) if s.getPath().getName().endswith(suffix)]
        return max(found)[1] if found else None


class ProofStore:
    """Documents as <id>.vrp.json in a folder."""

    suffix = ".vrp.json"

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Files(spark, folder)

    def save(self, doc: dict) -> str:
        return self.files.write(f"{doc['proof_id']}{self.suffix}", json.dumps(doc, indent=2).encode())

    def resolve(self, name: str = "latest") -> str:
        """The file's name of latest, an id or a file's name."""
        found = self.files.newest(self.suffix) if name == "latest" else name if name.endswith(self.suffix) else name + self.suffix
        if found is None or not self.files.exists(found):
            raise ConnectorError(f"no such document: {name}")
        return found

    def load(self, name: str = "latest") -> dict:
        return json.loads(self.files.read(self.resolve(name)))

    def table(self) -> DataFrame:
        """(path, document) of all documents, for verify_documents."""
        x = self.files.spark.read.format("binaryFile").option("pathGlobFilter", f"*{self.suffix}").load(self.files.root)
        return x.select("path", F.col("content").cast("string").alias("document"))


@dataclass(frozen=True)
class StoreConfig:
    """Where documents are: kind local with proofs_dir, or s3, gcs or adls with a bucket or container, and a prefix."""

    kind: str = "local"
    proofs_dir: str = ""
    bucket: str | None = None
    prefix: str | None = None
    region: str | None = None
    account: str | None = None
    container: str | None = None

    def folder(self) -> str:
        tail = f"/{self.prefix.strip('/')}" if self.prefix else ""
        if self.kind == "local":
            return self.proofs_dir
        if self.kind in ("s3", "gcs") and self.bucket:
            return f"{'s3a' if self.kind == 's3' else 'gs'}://{self.bucket}{tail}"
        if self.kind == "adls" and self.container and self.account:
            return f"abfss://{self.container}@{self.account}.dfs.core.windows.net{tail}"
        raise ConnectorError(f"the store {self.kind} lacks its bucket, account or container, or isn't known")
