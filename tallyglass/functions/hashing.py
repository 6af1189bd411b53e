"""Domain-separated hashes, fingerprints and salts, as Column expressions."""

from __future__ import annotations

import base64
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blake3 import blake3_climb, blake3_column, blake3_levels
from .canon import binary, encoded_fields
from .model import MissingIdentityField, Policy, ReconError, UnknownHashAlgorithm

# The tags that separate the hashes' domains.
LEAF, ID, CONTENT, FINGERPRINT, NODE, COMMUTATIVE = "00", "01", "02", "03", "10", "20"


def known_algorithm(algorithm: str) -> str:
    if algorithm not in ("sha256", "blake3"):
        raise UnknownHashAlgorithm(f"unsupported hash_algorithm: {algorithm}")
    return algorithm


def hash_of(data: Column, algorithm: str = "sha256") -> Column:
    """32 bytes: SHA-256 in generated code, or BLAKE3 by an Arrow UDF, since Spark has none."""
    if known_algorithm(algorithm) == "sha256":
        return F.unhex(F.sha2(data, 256))
    return blake3_column(data)


def id_hash(salt: bytes, canon: Column, algorithm: str = "sha256") -> Column:
    return hash_of(F.concat(binary(salt.hex() + ID), canon), algorithm)


def content_hash(salt: bytes, canon: Column, algorithm: str = "sha256") -> Column:
    return hash_of(F.concat(binary(salt.hex() + CONTENT), canon), algorithm)


def fingerprint_hash(i: Column, c: Column, algorithm: str = "sha256") -> Column:
    return hash_of(F.concat(binary(FINGERPRINT), i, c), algorithm)


def merkle_leaf(fp: Column, algorithm: str = "sha256") -> Column:
    return hash_of(F.concat(binary(LEAF), fp), algorithm)


def merkle_node(left: Column, right: Column, algorithm: str = "sha256") -> Column:
    return hash_of(F.concat(binary(NODE), left, right), algorithm)


def _level(nodes: Column) -> Column:
    pairs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: merkle_node(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.get(nodes, 2 * i))))


def merkle_fold(nodes: Column, levels: Column, algorithm: str = "sha256") -> Column:
    """nodes after so many levels; an odd last node is paired with itself."""
    if known_algorithm(algorithm) == "blake3":
        return F.element_at(blake3_levels(nodes, levels), -1)
    return F.when(levels <= 0, nodes).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), nodes, lambda a, _: _level(a)))


def merkle_levels(nodes: Column, levels: Column, algorithm: str = "sha256") -> Column:
    """The array of levels from the nodes themselves up to, but without, the last one."""
    if known_algorithm(algorithm) == "blake3":
        return F.slice(blake3_levels(nodes, levels), F.lit(1), levels)
    more = F.aggregate(F.sequence(F.lit(2), F.greatest(levels, F.lit(2))), F.array(nodes), lambda a, _: F.concat(a, F.array(_level(F.element_at(a, -1)))))
    return F.when(levels <= 0, F.array().cast("array<array<binary>>")).when(levels == 1, F.array(nodes)).otherwise(more)


def merkle_climb(leaf: Column, idx: Column, proof: Column, algorithm: str = "sha256") -> Column:
    """Where the proof leads from the leaf at idx."""
    if known_algorithm(algorithm) == "blake3":
        return blake3_climb(leaf, idx, proof)
    start = F.struct(leaf.alias("h"), idx.cast("long").alias("i"))
    step = lambda a, s: F.struct(F.when(a.i % 2 == 0, merkle_node(a.h, s)).otherwise(merkle_node(s, a.h)).alias("h"), F.shiftright(a.i, 1).alias("i"))
    return F.aggregate(proof, start, step).h


def new_salt() -> bytes:
    return secrets.token_bytes(32)


def parse_hash32(text: str) -> bytes:
    try:
        out = bytes.fromhex(text)
    except ValueError as e:
        raise ReconError(f"no hexadecimal hash: {text[:80]}") from e
    if len(out) != 32:
        raise ReconError("a hash has 32 bytes")
    return out


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if they are fewer bytes than a core's least part of a scan (spark.sql.files.openCostInBytes) for each core; a scan deals out larger ones itself. Streamed rows as they are."""
    if rows.isStreaming:
        return rows
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = int(str(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes").lower())))
    return rows.repartition(cores) if cores > 1 and size < cores * each else rows


def fingerprints(rows: DataFrame, policy: Policy, salt: bytes) -> DataFrame:
    """rows with id_hash, content_hash and fp; a map, without an exchange unless the rows are too few for all cores. Columns that are neither hashed nor kept are pruned at the scan.

    Columns whose names start with pos are carried: they order equal identities.
    """
    if missing := [f for f in policy.identity if f not in rows.columns]:
        raise MissingIdentityField(f"missing identity field: {missing[0]}")
    a = known_algorithm(policy.hash_algorithm)
    carried = [c for c in rows.columns if c.startswith("pos")]
    content = sorted(policy.effective, key=str.encode)
    names = list(dict.fromkeys([*policy.identity, *content]))
    x = encoded_fields(spread(rows.select(*(f"`{c}`" for c in dict.fromkeys([*carried, *names]) if c in rows.columns))), names, policy.canon, carried)
    joined = lambda fields: F.concat(*(F.col(f"__e{names.index(f)}") for f in fields)) if fields else F.lit(b"")
    x = x.select(*(F.col(f"`{c}`") for c in carried), id_hash(salt, joined(policy.identity), a).alias("id_hash"), content_hash(salt, joined(content), a).alias("content_hash"))
    return x.withColumn("fp", fingerprint_hash(F.col("id_hash"), F.col("content_hash"), a))
