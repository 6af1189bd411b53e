"""init, reconcile, verify, report and doctor: python -m tallyglass COMMAND, or by spark-submit."""

from __future__ import annotations

import argparse
import base64
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.hashing import new_salt
from .functions.model import ReconError, check_schema_drift
from .functions.proof import Ed25519, build_signer, producer_with_key, verify_document
from .operators import faults
from .plans.config import TEMPLATE, ReconConfig
from .plans.document import build_document
from .sources.connectors import KafkaLog, SnapshotTable, build_sink, build_source, fingerprint_boundary, fingerprint_sink
from .sources.stores import ProofStore


def session() -> SparkSession:
    return SparkSession.builder.appName("tallyglass").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def write_metrics(folder: str, **counts: int) -> Path:
    """Counters as Prometheus text; each command writes its own run's."""
    out = []
    for name, n in counts.items():
        out += [f"# TYPE tallyglass_{name} counter", f"tallyglass_{name} {n}"]
    at = Path(folder) / "metrics.prom"
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("\n".join(out) + "\n")
    return at


def init(spark: SparkSession, config: str, data: str, force: bool = False) -> list[str]:
    """Writes the configuration, a key pair and the folders; keeps what is there unless force."""
    made = []
    if force or not Path(config).exists():
        ReconConfig.parse(TEMPLATE.format(data=data)).save(config)
        made.append(config)
    c = ReconConfig.load(config)
    private, public = Path(c.crypto["private_key_file"]), Path(c.crypto["public_key_file"])
    if force or not private.exists():
        private.parent.mkdir(parents=True, exist_ok=True)
        public.parent.mkdir(parents=True, exist_ok=True)
        seed, key = Ed25519(spark).generate()
        private.write_text(base64.b64encode(seed).decode() + "\n")
        private.chmod(0o600)
        public.write_text(base64.b64encode(key).decode() + "\n")
        made += [str(private), str(public)]
    return made


def _schema(c: ReconConfig) -> str:
    names = dict.fromkeys([*c.to_policy().identity, *c.policy["content_fields"]])
    return ", ".join(f"`{n}` string" for n in names)


def demo_source(spark: SparkSession, c: ReconConfig) -> KafkaLog:
    """The boundary's offsets, each with an order record as JSON."""
    log = None
    for p in c.source["boundary"]["partitions"]:
        n = p["end"] - p["start"] + 1
        x = faults.sample_records(spark, n).select(F.lit(p["id"]).cast("int").alias("partition"), (F.col("pos") + p["start"]).alias("offset"), F.to_json(F.struct("order_id", "line_id", "amount", "status")).cast("binary").alias("value"))
        log = x if log is None else log.unionByName(x)
    return KafkaLog(log, _schema(c), c.source["topic"])


def run_reconcile(spark: SparkSession, config: str, demo: bool = False) -> dict:
    """Reconciles what the configuration names, and stores the signed document."""
    c = ReconConfig.load(config)
    policy, salt, boundary = c.to_policy(), new_salt(), c.source_boundary()
    sink = build_sink(spark, c.sink)
    if demo:
        source = demo_source(spark, c)
        number = c.sink["boundary"]["snapshot_from"]
        if isinstance(sink, SnapshotTable) and number not in sink.snapshot_ids():
            sink.write_snapshot(source.rows(boundary).drop("pos", "pos_text"), number)
    else:
        source = build_source(spark, c.source, boundary, _schema(c))
    if c.sink.get("expected_schema") and (d := check_schema_drift(c.sink["expected_schema"], sink.field_names())):
        raise ReconError(f"the sink's schema has drifted: missing {d.missing}, unexpected {d.unexpected}")
    left = fingerprint_boundary(source, boundary, policy, salt)
    right = fingerprint_sink(sink, c.sink_boundary(), policy, salt)
    provider, key_id = c.crypto.get("kms_provider") or "file", c.crypto.get("kms_key_id")
    signer = build_signer(spark, provider, c.crypto["private_key_file"], key_id)
    public = base64.b64decode(Path(c.crypto["public_key_file"]).read_text().strip())
    doc = build_document(left, right.fingerprints, policy, salt, boundary, signer, public, producer_with_key(c.producer, provider, key_id), (source.ref(), sink.ref()))
    ProofStore(spark, c.store_config().folder()).save(doc)
    return doc


def _loaded(spark: SparkSession, c: ReconConfig, proof: str) -> dict:
    return json.loads(Path(proof).read_text()) if Path(proof).is_file() else ProofStore(spark, c.store_config().folder()).load(proof)


def run_verify(spark: SparkSession, config: str, proof: str = "latest", key: str | None = None) -> tuple[str, str, dict]:
    c = ReconConfig.load(config)
    doc = _loaded(spark, c, proof)
    return *verify_document(doc, base64.b64decode(Path(key or c.crypto["public_key_file"]).read_text().strip()), spark), doc


def report(doc: dict, outcome: str) -> str:
    r = doc["reconciliation"]
    lines = [f"document    {doc['proof_id']}", f"created     {doc['created_at']}", f"producer    {doc['producer']}", f"verdict     {r['verdict']}", f"verified    {outcome}", f"source      {doc['source_ref']}, {doc['source_commitment']['count']} rows", f"sink        {doc['sink_ref']}, {doc['sink_commitment']['count']} rows", f"matched     {r['matched']['count']}"]
    lines += [f"{k:<11} {len(r[k])}" for k in ("missing", "duplicated", "mutated")]
    return "\n".join(lines + ([f"unverified  {r['unverified_reason']}"] if r["unverified_reason"] else []))


def doctor(spark: SparkSession, config: str) -> list[tuple[str, bool, str]]:
    """(check, whether it holds, detail)."""
    out = [("configuration", Path(config).exists(), config)]
    try:
        c = ReconConfig.load(config)
    except (ReconError, OSError) as e:
        return [*out, ("readable", False, str(e))]
    out.append(("readable", True, config))
    for name in ("private_key_file", "public_key_file"):
        out.append((name, Path(c.crypto[name]).exists(), str(c.crypto[name])))
    try:
        signer = build_signer(spark, c.crypto.get("kms_provider") or "file", c.crypto["private_key_file"], c.crypto.get("kms_key_id"))
        public = base64.b64decode(Path(c.crypto["public_key_file"]).read_text().strip())
        out.append(("keys fit", Ed25519(spark).verify(public, b"doctor", signer.sign(b"doctor")), signer.key_id))
    except (ReconError, OSError, ValueError) as e:
        out.append(("keys fit", False, str(e)))
    for name, make in (("sink", lambda: build_sink(spark, c.sink).ref()), ("store", lambda: c.store_config().folder()), ("policy", lambda: str(c.to_policy().identity))):
        try:
            out.append((name, True, make()))
        except Exception as e:  # whatever a connector finds wrong is the finding
            out.append((name, False, str(e).splitlines()[0]))
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyglass", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    made = {n: sub.add_parser(n) for n in ("init", "reconcile", "verify", "report", "doctor")}
    for x in made.values():
        x.add_argument("--config", default="recon.yaml")
        x.add_argument("--metrics", help="folder for the counters of this run")
    made["init"].add_argument("--data-dir", default=".tallyglass")
    made["init"].add_argument("--force", action="store_true")
    made["reconcile"].add_argument("--demo", action="store_true")
    for n in ("verify", "report"):
        made[n].add_argument("proof", nargs="?", default="latest")
        made[n].add_argument("--pubkey")
    made["verify"].add_argument("--check", action="store_true")
    a = p.parse_args(args)
    spark = spark or session()
    counts: dict[str, int] = {}
    code = 0
    try:
        if a.command == "init":
            print("\n".join(f"wrote {x}" for x in init(spark, a.config, a.data_dir, a.force)) or "nothing to do")
        elif a.command == "reconcile":
            doc = run_reconcile(spark, a.config, a.demo)
            counts["reconcile_total"] = 1
            print(f"{doc['reconciliation']['verdict']} {doc['proof_id']}")
        elif a.command == "doctor":
            found = doctor(spark, a.config)
            print("\n".join(f"{'ok  ' if good else 'FAIL'} {name}: {detail}" for name, good, detail in found))
            code = 0 if all(good for _, good, _ in found) else 1
        else:
            outcome, why, doc = run_verify(spark, a.config, a.proof, a.pubkey)
            if a.command == "report":
                print(report(doc, outcome))
            else:
                counts["verify_pass_total"], counts["verify_fail_total"] = int(outcome == "PASS"), int(outcome != "PASS")
                code = 0 if outcome == "PASS" else 1
                print(f"CHECK={'FAIL' if code else 'OK'}" if a.check else f"{outcome}: {why}")
    except (ReconError, OSError) as e:
        print(f"error: {e}")
        code = 1
    if a.metrics:
        write_metrics(a.metrics, **counts)
    return code
