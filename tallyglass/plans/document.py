"""From two frames of fingerprints to a signed document.

A document holds its evidence rows, or, where they are too many for one, commits to
tables of them: their numbers and Merkle roots are in the document, the rows are written
and checked by tasks and never reach the driver.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_of, known_algorithm, merkle_leaf
from ..functions.model import Boundary, Policy, PositionKind, ReconError
from ..functions.proof import VERSION, Ed25519, policy_form, sign_document, verify_content
from ..operators.merkle import inclusion_proofs, merkle_root, verified_inclusion
from ..operators.reconcile import Reconciliation, reconcile, verdict_of

#: Rows of a source up to which a verifier may look for a missing record's place by itself; beyond, documents name it.
SEARCHED = 1 << 16


def _root(fps: DataFrame, algorithm: str, weight: str | None = None) -> dict:
    r = merkle_root(fps, algorithm=algorithm, weight=weight).first()
    return {"count": r["count"], "merkle_root": bytes(r.merkle_root).hex()}


def _position(text: str, kind: PositionKind) -> str:
    return base64.b64encode(json.dumps({"kind": kind.value, "value": text.encode().hex()}, separators=(",", ":")).encode()).decode()


#: The tables of evidence, with the sums that a document has besides their numbers of rows.
EVIDENCE = {
    "missing": ("id_hash binary, source_pos string, merkle_leaf binary, leaf_index long, inclusion_proof array<binary>", None),
    "duplicated": ("id_hash binary, source_multiplicity long, sink_multiplicity long", ("excess", "greatest(sink_multiplicity - source_multiplicity, 0)")),
    "mutated": ("id_hash binary, source_content_hash binary, sink_content_hash binary, copies long", ("copies", "copies")),
}


def _evidence(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{n}") for n, (schema, _) in EVIDENCE.items()}


def _committed(rows: DataFrame, name: str, algorithm: str) -> dict:
    """Number, Merkle root and sum of a table of evidence; a row's bytes are its JSON, with binary fields in base64."""
    text = F.to_json(F.struct(*rows.columns))
    out = _root(rows.select(hash_of(F.encode(text, "UTF-8"), algorithm).alias("fp")), algorithm)
    total = EVIDENCE[name][1]
    return out | ({total[0]: rows.agg(F.sum(F.expr(total[1]))).first()[0] or 0} if total else {})


def write_evidence(r: Reconciliation, source: DataFrame, folder: str, algorithm: str) -> dict[str, DataFrame]:
    """All evidence of a comparison as tables under folder, each missing record with its place and proof in the source's tree."""
    lost = r.missing.select("fp", "id_hash", F.to_json(F.struct("pos")).alias("source_pos"), merkle_leaf(F.col("fp"), algorithm).alias("merkle_leaf"))
    proofs = inclusion_proofs(source, lost, algorithm=algorithm)
    missing = lost.join(proofs.select(F.col("leaf").alias("merkle_leaf"), F.col("idx").alias("leaf_index"), F.col("proof").alias("inclusion_proof")), "merkle_leaf")
    for n, df in (("missing", missing), ("duplicated", r.duplicated), ("mutated", r.mutated_copies)):
        df.selectExpr(*(c.split()[0] for c in EVIDENCE[n][0].split(", "))).write.parquet(f"{folder.rstrip('/')}/{n}")
    return _evidence(source.sparkSession, folder)


def tables_wrong(doc: dict, spark: SparkSession, folder: str) -> str | None:
    """What is wrong with a document's tables of evidence: other rows than it commits to, or a missing record that the source's root doesn't hold."""
    a = doc["hash_algorithm"]
    tables = _evidence(spark, folder)
    for n, rows in tables.items():
        if _committed(rows, n, a) != doc["reconciliation"]["evidence"][n]:
            return f"the table of {n} rows is not that of the document"
    root = F.unhex(F.lit(doc["source_commitment"]["merkle_root"]))
    held = verified_inclusion(F.col("merkle_leaf"), F.col("leaf_index"), F.col("inclusion_proof"), root, a)
    return None if tables["missing"].where(~F.coalesce(held, F.lit(False))).isEmpty() else "a missing record is not in the source"


def verify_with_tables(doc: dict, public: bytes, spark: SparkSession, folder: str) -> tuple[str, str]:
    """verify_document, also of a document whose evidence is in tables under folder."""
    return verify_content(doc, public, Ed25519(spark).verify, lambda d: tables_wrong(d, spark, folder))


def build_document(source: DataFrame, sink: DataFrame, policy: Policy, salt: bytes, boundary: Boundary, signer, public: bytes, producer: str = "tallyglass", refs: tuple[str, str] = ("source", "sink"), reason: str | None = None, prev: str | None = None, limit: int = 100_000, created_at: str | None = None, kind: PositionKind = PositionKind.KAFKA_OFFSET, tables: str | None = None) -> dict:
    """Reconciles, commits to both sides and what matched, and signs. More evidence rows than limit go to tables in the folder that tables names; without one they are an error, since a document has to hold all of them.

    A pair of contents that was mutated several times is one entry with its number of
    copies; a missing record of a large source carries its place in the tree. Other
    documents have no more than the fields of the form.
    """
    if len(salt) != 32:
        raise ReconError("a salt has 32 bytes")
    a = known_algorithm(policy.hash_algorithm)
    r = reconcile(source, sink, a)
    try:
        s = r.summary()
        row = s.withColumn("verdict", verdict_of(s, policy.tolerances, reason)).first()
        many = max(row.missing, row.mutated, row.duplicated) > limit
        if many and tables is None:
            raise ReconError(f"more than {limit} evidence rows; read them as frames instead")
        missing = []
        evidence = {n: _committed(rows, n, a) for n, rows in write_evidence(r, source, tables, a).items()} if many else None
        if row.missing and not many:
            lost = r.missing
            proofs = {bytes(p.leaf): p for p in inclusion_proofs(source, lost, algorithm=a).collect()}
            rows = lost.select("id_hash", merkle_leaf(F.col("fp"), a).alias("leaf"), "pos", F.to_json(F.struct("pos")).alias("text")).orderBy("id_hash", "pos").collect()
            for m in rows:
                p = proofs[bytes(m.leaf)]
                at = json.dumps(json.loads(m.text).get("pos"), separators=(",", ":"))
                missing.append({"id_hash": bytes(m.id_hash).hex(), "source_pos": _position(at, kind), "merkle_leaf": bytes(m.leaf).hex(), "inclusion_proof": [bytes(h).hex() for h in p.proof]} | ({"leaf_index": p.idx} if row.source_count > SEARCHED else {}))
        pairs = r.mutated_copies.orderBy("id_hash", "source_content_hash", "sink_content_hash").collect() if row.mutated and not many else []
        double = r.duplicated.orderBy("id_hash").collect() if row.duplicated and not many else []
        doc = {
            "vrp_version": VERSION, "producer": producer, "created_at": created_at,
            "boundary": {"mode": boundary.mode.value, "value": base64.b64encode(boundary.value).decode()},
            "source_ref": refs[0], "sink_ref": refs[1], "hash_algorithm": a, "canon_version": policy.canon.version, "salt": base64.b64encode(salt).decode(),
            "source_commitment": _root(source, a), "sink_commitment": _root(sink, a),
            "reconciliation": {
                "matched": _root(r.matched_fingerprints, a, "copies"), "missing": missing,
                "duplicated": [{"id_hash": bytes(d.id_hash).hex(), "source_multiplicity": d.source_multiplicity, "sink_multiplicity": d.sink_multiplicity} for d in double],
                "mutated": [{"id_hash": bytes(m.id_hash).hex(), "source_content_hash": bytes(m.source_content_hash).hex(), "sink_content_hash": bytes(m.sink_content_hash).hex()} | ({"copies": m.copies} if m.copies > 1 else {}) for m in pairs],
                "verdict": row.verdict, "unverified_reason": reason,
            } | ({"evidence": evidence} if many else {}),
            "policy": policy_form(policy), "chain": {"prev_proof_hash": prev},
        }
        return sign_document(doc, signer, public)
    finally:
        r.release()
