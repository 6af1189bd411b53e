"""Golden values, the greedy comparison against the plan, proofs and documents."""

import base64
import hashlib
import json
import os
import threading
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyglass.functions.canon import canonical_decimal, double_decimal, double_text, encode_fields, normalized_timestamp
from tallyglass.functions.hashing import fingerprints
from tallyglass.functions.model import Boundary, CanonSpec, DuplicatePolicy, InvalidBoundary, InvalidIdentityRule, MissingIdentityField, Policy, Tolerances, identity_fields, late_window_seconds
from tallyglass import cli
from tallyglass.functions import ed25519
from tallyglass.functions.blake3 import blake3_many
from tallyglass.functions.proof import Ed25519, chain_breaks, form_errors, from_cbor, inclusion_holds, sign_document, to_cbor, verify_document, verify_documents
from tallyglass.operators import faults
from tallyglass.operators import reconcile as reconcile_module
from tallyglass.operators.merkle import commutative_root, inclusion_proofs, merkle_root, verified_anywhere, verified_inclusion
from tallyglass.operators.reconcile import reconcile, verdict_of
from tallyglass.plans.document import build_document
from tallyglass.plans.queries import TEST_PUBLIC, TEST_SEED, VECTORS, SeedSigner, vector_documents
from tallyglass.sources.boundary import bounded, max_messages, offset_range, sql_filter
from tallyglass.sources.connectors import KafkaLog, SnapshotTable, fingerprint_sink, kafka_position
from tallyglass.sources.pubsub import pull
from tallyglass.sources.stores import ProofStore, StoreConfig
from tallyglass.streaming.batches import reconcile_stream, windowed_commitment

SALT = bytes([0xAB]) * 32
SORTED = Policy("composite:[line_id,order_id]", ("order_id", "line_id", "amount", "status"), ("_meta",))


def root(df, weight=None):
    r = merkle_root(df, weight=weight).first()
    return r["count"], bytes(r.merkle_root).hex()


def test_golden_values(spark):
    d = faults.sample_records(spark, 5)
    fp = fingerprints(d, SORTED, SALT)
    assert root(fp) == (5, "d2cdb0e66056a633d01613a6fc551ed8340da23b6ddf3a8afe166dfdddd62bfe")
    last = fp.where("pos = 4").first()
    assert bytes(last.id_hash).hex() == "06505a3d80fc20c052cc377f3e1c5cdbef72761358d1d94dbce59b7ac0166dde"
    assert root(fingerprints(faults.drop(d, F.col("order_id") == "1004"), SORTED, SALT)) == (4, "9dad061dd6b1dcd73a5a08c0d010fbc96ab35ffb211ecec0c7b22077975a49fa")
    changed = fingerprints(faults.mutate(d, F.col("order_id") == "1002", "amount", "dec:999.99"), SORTED, SALT)
    assert root(changed)[1] == "c7a474a19569eed42c9f3b7c924dd3659249dd0eb3adbcee20268909995f962e"
    assert root(reconcile(fp, changed).matched) == root(reconcile(fp, changed).matched_fingerprints, "copies") == (4, "a4f45cb97fd2a8de758c88e4d701302d9f3526daef8424df5540f6878821a205")
    assert root(fp.limit(0)) == (0, "7f9c9e31ac8256ca2f258583df262dbc7d6f68f2a03043d5c99a4ae5a7396ce9")
    declared = Policy("composite:[order_id,line_id]", SORTED.content_fields)
    assert root(fingerprints(d, declared, SALT))[1] == "b817e17f0b8c38336d38384b1aad8984325c9a15d889cb71e69884d7e94dc762"


def greedy(source, sink):
    """Counts, and the positions or contents of each class, by the plain loop."""
    by = defaultdict(lambda: ([], []))
    for side, rows in enumerate((source, sink)):
        for p, (i, c) in enumerate(rows):
            by[i][side].append((p, c))
    matched, missing, mutated, duplicated = [], [], [], 0
    for i, (s, k) in by.items():
        duplicated += len(k) > len(s)
        k, left = list(k), []
        for p, c in s:
            same = next((x for x in k if x[1] == c), None)
            if same:
                k.remove(same)
                matched.append((i, c, p))
            else:
                left.append((p, c))
        mutated += [(i, a[1], b[1]) for a, b in zip(left, k)]
        missing += [(i, c, p) for p, c in left[len(k) :]]
    return sorted(matched), sorted(missing), sorted(mutated), duplicated


@pytest.mark.parametrize("seed,at", [(0, None), (1, 3), (2, 3), (3, 3)])
def test_reconcile_is_the_greedy_comparison(spark, monkeypatch, seed, at):
    import random

    if at:  # groups of over three rows are ranked by ranges
        monkeypatch.setattr(reconcile_module, "RANGE", at)
    g = random.Random(seed)
    ids = 6 if seed % 2 else 2
    sides = [[(g.randrange(ids), g.randrange(3)) for _ in range(g.randrange(5, 60))] for _ in range(2)]

    def frame(rows):
        h = lambda *x: hashlib.sha256(repr(x).encode()).digest()
        rows = [(bytes([i]), bytes([c]), h("fp", i, c), (0, p) if seed > 1 else (p // 7, p)) for p, (i, c) in enumerate(rows)]
        return spark.createDataFrame(rows, "id_hash binary, content_hash binary, fp binary, pos struct<a: long, b: long>")

    r = reconcile(frame(sides[0]), frame(sides[1]))
    matched, missing, mutated, duplicated = greedy(*sides)
    at = lambda d: sorted((x.id_hash[0], x.content_hash[0], x.pos.b) for x in d.collect())
    assert at(r.matched) == matched and at(r.missing) == missing
    assert sorted(x for p in r.mutated_copies.collect() for x in [(p.id_hash[0], p.source_content_hash[0], p.sink_content_hash[0])] * p.copies) == mutated
    s = r.summary().first()
    assert (s.matched, s.missing, s.mutated_copies, s.mutated, s.duplicated) == (len(matched), len(missing), len(mutated), len(set(mutated)), duplicated)
    assert s.matched + s.missing + s.mutated_copies == s.source_count == len(sides[0])


def folded(leaves):
    level = sorted(leaves)
    while len(level) > 1:
        level = [hashlib.sha256(b"\x10" + level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [1, 5, 70])
def test_merkle_blocks_and_proofs(spark, n):
    fps = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    copies = fps + fps[: n // 2] * 3  # equal leaves
    d = spark.createDataFrame([(x,) for x in copies], "fp binary")
    want = folded([hashlib.sha256(b"\0" + x).digest() for x in copies])
    assert bytes(merkle_root(d, bits=3).first().merkle_root) == want == bytes(merkle_root(d).first().merkle_root)
    for x in (inclusion_proofs(d, d, bits=3), inclusion_proofs(d, d.limit(3))):
        p = x.withColumn("good", verified_inclusion(F.col("leaf"), F.col("idx"), F.col("proof"), F.lit(want))).collect()
        assert len(p) in (n, min(n, 3), 2, 1) and all(r.good for r in p)
        places = sorted(hashlib.sha256(b"\0" + x).digest() for x in copies)
        assert all(places.index(bytes(r.leaf)) == r.idx for r in p)
    x = 0
    for f in fps:
        x ^= int.from_bytes(f, "big")
    assert bytes(commutative_root(d.limit(n)).first().commutative_root) == hashlib.sha256(b"\x20" + x.to_bytes(32, "big")).digest()


def test_proofs_of_large_trees(spark):
    """A place beyond 2^20 verifies by its index, and without one by trying the sides."""
    g = hashlib.sha256
    for place, depth in ((3_000_017, 22), (777, 10)):
        leaf, proof = g(b"leaf").digest(), [g(bytes([i])).digest() for i in range(depth)]
        h = leaf
        for i, s in enumerate(proof):
            h = g(b"\x10" + (s + h if place >> i & 1 else h + s)).digest()
        d = spark.createDataFrame([(leaf, place, proof, h)], "leaf binary, idx long, proof array<binary>, root binary")
        c = F.col
        assert d.select(verified_inclusion(c("leaf"), c("idx"), c("proof"), c("root"))).first()[0]
        assert not d.select(verified_inclusion(c("leaf"), c("idx") - 1, c("proof"), c("root"))).first()[0]
        assert inclusion_holds(leaf, proof, h, place) and not inclusion_holds(leaf, proof, h, place - 1)
        if depth < 20:
            assert d.select(verified_anywhere(c("leaf"), c("proof"), c("root"))).first()[0] and inclusion_holds(leaf, proof, h)
            assert not inclusion_holds(leaf, proof, bytes(32))


def test_blake3(spark):
    # published hashes of the empty text, of abc, and of 0, 1, ... 250, 0, ... of some lengths
    assert [x.hex() for x in blake3_many([b"", b"abc"])] == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"]
    data = bytes(i % 251 for i in range(4000))
    sizes = (1023, 1024, 1025, 2048, 2049, 3072, 3073)
    assert [x.hex()[:16] for x in blake3_many([data[:n] for n in sizes])] == ["10108970eeda3eb9", "42214739f095a406", "d00278ae47eb27b3", "e776b6028c7cd22a", "5f4d72f40d7a5f82", "b98cb0ff3623be03", "7124b49501012f81"]


def test_ed25519(spark):
    jvm = Ed25519(spark)
    for m in (b"", b"abc", bytes(500)):
        s = jvm.sign(TEST_SEED, m)
        assert ed25519.verified(TEST_PUBLIC, m, s) and jvm.verify(TEST_PUBLIC, m, s)
        for bad in (s[:-1], s[:5] + b"\0" + s[6:], b"\xff" * 64):
            assert not ed25519.verified(TEST_PUBLIC, m, bad)
        assert not ed25519.verified(TEST_PUBLIC, m + b"x", s) and not ed25519.verified(bytes(31), m, s)


def test_canonical_values(spark):
    rows = spark.createDataFrame([("1.5",), (" 12 ",), ("-0.1234567",), ("3.",)], "s string")
    assert [r[0] for r in rows.select(canonical_decimal(F.col("s"))).collect()] == ["1.500000", "12.000000", "-0.123456", "3.000000"]
    d = spark.createDataFrame([(1e7,), (1.5,), (1e-4,), (-2.25e10,), (1e21,), (0.1234567,), (None,)], "d double")
    assert [r[0] for r in d.select(double_text(F.col("d"))).collect()] == ["10000000", "1.5", "0.0001", "-22500000000", "1000000000000000000000", "0.1234567", None]
    assert [r[0] for r in d.select(double_decimal(F.col("d"), 6)).collect()] == ["10000000.000000", "1.500000", "0.000100", "-22500000000.000000", "1000000000000000000000.000000", "0.123456", None]
    with pytest.raises(Exception, match="invalid decimal"):
        spark.createDataFrame([("x1",)], "s string").select(canonical_decimal(F.col("s"))).collect()
    x = spark.createDataFrame([(None, "", "é", ["b", "a"], True)], "a string, b string, c string, d array<string>, e boolean")
    b = bytes(x.select(encode_fields(x, ["a", "b", "c", "d", "e"], CanonSpec(array_as_set=True)).alias("x")).first().x)
    assert b.hex() == "f00000000161a0" + "f00000000162a200000000" + "f00000000163a200000002c3a9" + "f00000000164a500000002a20000000161a20000000162" + "f00000000165a101"


def test_normal_form_and_time_zones(spark):
    x = spark.createDataFrame([(["e\u0301", None], "e\u0301", [["e\u0301"]]), (None, None, None), ([], "", [None])], "a array<string>, b string, c array<array<string>>")
    y = spark.createDataFrame([(["\u00e9", None], "\u00e9", [["\u00e9"]]), (None, None, None), ([], "", [None])], x.schema)
    got, want = ([bytes(r[0]).hex() for r in d.select(encode_fields(d, ["a", "b", "c"], CanonSpec())).collect()] for d in (x, y))
    assert got == want and got[0].count("a200000002c3a9") == 3
    t = spark.sql("select timestamp_micros(1774747800250000) as t, timestamp_ntz'2026-03-29 02:30:00' as n")
    for zone in ("UTC", "Europe/Berlin", "America/New_York"):  # the literals are instants; only their rendering depends on the zone
        spark.conf.set("spark.sql.session.timeZone", zone)
        b = bytes(t.select(encode_fields(t, ["t", "n"], CanonSpec())).first()[0])
        assert b"2026-03-29T01:30:00.250000Z" in b and b"2026-03-29T02:30:00.000000Z" in b
        assert spark.range(1).select(normalized_timestamp(F.lit("2026-01-01T12:00:00+05:00"))).first()[0] == "2026-01-01T07:00:00.000000Z"
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rules_and_boundaries(spark):
    assert identity_fields("composite:[b, a]") == ["b", "a"]
    for bad in ("composite:[a,,b]", "field:", "a"):
        with pytest.raises(InvalidIdentityRule):
            identity_fields(bad)
    assert [late_window_seconds(x) for x in ("900s", "120", "PT15M", "soon", "PT")] == [900, 120, 900, None, None]
    with pytest.raises(MissingIdentityField):
        fingerprints(spark.range(1), Policy("field:no", ("id",)), SALT)
    with pytest.raises(InvalidBoundary):
        offset_range(Boundary.of("BATCH_ID", {}))
    log = KafkaLog(spark.createDataFrame([(0, i, b'{"a": "x"}') for i in range(5)], "partition int, offset long, value binary"), "a string")
    log = log.produce(spark.createDataFrame([(0, 2, b'{"a": "y"}')], "partition int, offset long, value binary"))
    got = log.rows(Boundary.of("OFFSET_RANGE", {"partitions": [{"id": 0, "start": 1, "end": 2}]})).orderBy("pos").collect()
    assert [r.a for r in got] == ["x", "y"]


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}", "orders")
    d = faults.sample_records(spark, 6).drop("pos")
    t.write_snapshot(d.where("order_id < 1003"), 1)
    t.write_snapshot(d.where("order_id >= 1003"), 2)
    at = lambda a, b: t.rows(Boundary.of("BATCH_ID", {"snapshot_from": a, "snapshot_to": b}))
    assert at(1, 2).count() == 6 and sorted(r.order_id for r in at(2, 2).collect()) == ["1003", "1004", "1005"]
    assert t.field_names() == d.columns and t.snapshot_ids() == [1, 2]
    batch = fingerprint_sink(t, Boundary.of("BATCH_ID", {"snapshot_from": 1, "snapshot_to": 2}), Policy("field:order_id", ("order_id", "amount")), SALT)
    assert batch.fingerprints.count() == 6 and batch.pushdown_used
    odd = SnapshotTable(spark, f"file://{tmp_path}/a b+c%20d", "orders")
    odd.write_snapshot(d, 1)
    assert odd.rows(Boundary.of("BATCH_ID", {"snapshot_from": 1, "snapshot_to": 1})).count() == 6
    with pytest.raises(InvalidBoundary):
        at(5, 6)


@pytest.fixture(scope="module")
def documents(spark):
    return vector_documents(spark)


def test_blake3_document(spark):
    doc = vector_documents(spark, "blake3", ["drop"])["drop"]
    assert verify_document(doc, TEST_PUBLIC, spark) == ("FAIL", "the document holds")
    assert form_errors(doc) == [] and doc["hash_algorithm"] == "blake3"


def test_documents(spark, tmp_path, documents):
    docs = documents
    store = ProofStore(spark, str(tmp_path))
    for name, doc in docs.items():
        assert form_errors(doc) == []
        want = ("FAIL", "bad signature") if name == "tampered" else (VECTORS[name], "the document holds")
        assert verify_document(doc, TEST_PUBLIC, spark) == want
        assert from_cbor(to_cbor(doc)) == doc
        assert "1002" not in str(doc["reconciliation"])
        if name != "tampered":
            store.save(doc)
    assert store.load(docs["drop"]["proof_id"]) == docs["drop"]
    assert sorted(r.outcome for r in verify_documents(store.table(), TEST_PUBLIC).collect()) == ["FAIL", "FAIL", "FAIL", "PASS"]
    doc = docs["valid"]
    assert verify_document(doc | {"producer": "x"}, TEST_PUBLIC, spark)[0] == "FAIL"
    assert verify_document(doc, bytes(32), spark)[1] == "bad signature"
    assert form_errors({k: v for k, v in doc.items() if k != "salt"} | {"more": 1}) == [".more: unknown", ".salt: missing"]
    assert doc["source_commitment"]["merkle_root"] == "d2cdb0e66056a633d01613a6fc551ed8340da23b6ddf3a8afe166dfdddd62bfe"
    bad = spark.createDataFrame([(None,), ("[]",), ("{",), (json.dumps(doc | {"chain": {}}),)], "document string")
    assert {r.outcome for r in verify_documents(bad, TEST_PUBLIC).collect()} == {"FAIL"}


def resigned(spark, doc, **changes):
    out = json.loads(json.dumps(doc))
    for path, value in changes.items():
        *way, last = path.split("__")
        at = out
        for w in way:
            at = at[w]
        at[last] = value
    return sign_document(out, SeedSigner(spark), TEST_PUBLIC)


def test_verification_rules(spark, documents):
    docs = documents
    for path in ("source_commitment", "sink_commitment", "reconciliation__matched"):
        assert verify_document(resigned(spark, docs["valid"], **{f"{path}__merkle_root": "0" * 64}), TEST_PUBLIC, spark)[0] == "FAIL"
        assert "add up" in verify_document(resigned(spark, docs["valid"], **{f"{path}__count": 4}), TEST_PUBLIC, spark)[1]
    assert "root" in verify_document(resigned(spark, docs["drop"], sink_commitment__merkle_root="1" * 64), TEST_PUBLIC, spark)[1]
    assert verify_document(resigned(spark, docs["valid"], source_commitment__merkle_root="00"), TEST_PUBLIC, spark)[0] == "FAIL"
    assert verify_document(resigned(spark, docs["valid"], hash_algorithm="md5"), TEST_PUBLIC, spark)[0] == "UNVERIFIED"
    assert verify_document(resigned(spark, docs["valid"], canon_version=2), TEST_PUBLIC, spark)[0] == "UNVERIFIED"
    assert verify_document(resigned(spark, docs["valid"], policy__late_arrival_window="soon"), TEST_PUBLIC, spark)[0] == "FAIL"
    assert verify_document(resigned(spark, docs["drop"], reconciliation__verdict="PASS"), TEST_PUBLIC, spark)[0] == "FAIL"
    assert verify_document(resigned(spark, docs["valid"], salt="AA=="), TEST_PUBLIC, spark)[0] == "FAIL"
    lost = json.loads(json.dumps(docs["drop"]["reconciliation"]["missing"]))
    lost[0]["inclusion_proof"][1] = "2" * 64
    assert "not in the source" in verify_document(resigned(spark, docs["drop"], reconciliation__missing=lost), TEST_PUBLIC, spark)[1]


def test_equal_mutated_copies_balance(spark):
    """Two copies that changed alike are one entry with a multiplicity."""
    d = faults.sample_records(spark, 3)
    d = d.unionByName(d.where("pos = 1").withColumn("pos", F.lit(9).cast("long")))
    policy = Policy(SORTED.identity_rule, SORTED.content_fields, tolerances=Tolerances(max_mutations=1))
    sink = faults.mutate(d, F.col("order_id") == "1001", "amount", "dec:1")
    doc = build_document(fingerprints(d, policy, SALT), fingerprints(sink, policy, SALT), policy, SALT, Boundary.of("BATCH_ID", {"batch_id": "x"}), SeedSigner(spark), TEST_PUBLIC)
    assert [m["copies"] for m in doc["reconciliation"]["mutated"]] == [2]
    assert verify_document(doc, TEST_PUBLIC, spark) == ("PASS", "the document holds")


def test_evidence_in_tables(spark, tmp_path):
    """More evidence than a document may hold goes to tables that it commits to."""
    from tallyglass.functions.model import ReconError
    from tallyglass.plans.document import verify_with_tables

    d = faults.sample_records(spark, 9)
    at = F.col("pos")
    sink = faults.duplicate(faults.mutate(faults.drop(d, at.isin(4, 5)), at == 2, "amount", "dec:1"), at == 7)
    sides = [fingerprints(x, SORTED, SALT) for x in (d, sink)]
    build = lambda **more: build_document(*sides, SORTED, SALT, Boundary.of("BATCH_ID", {"batch_id": "x"}), SeedSigner(spark), TEST_PUBLIC, created_at="2000-01-01T00:00:00Z", **more)
    with pytest.raises(ReconError):
        build(limit=1)
    doc, folder = build(limit=1, tables=f"{tmp_path}/a"), f"{tmp_path}/a"
    e = doc["reconciliation"]["evidence"]
    assert form_errors(doc) == [] and (e["missing"]["count"], e["mutated"]["count"], e["mutated"]["copies"], e["duplicated"]["count"], e["duplicated"]["excess"]) == (2, 1, 1, 1, 1)
    assert verify_with_tables(doc, TEST_PUBLIC, spark, folder) == ("FAIL", "the document holds") and doc["reconciliation"]["verdict"] == "FAIL"
    assert verify_document(doc, TEST_PUBLIC, spark)[0] == "UNVERIFIED"
    rows = spark.read.parquet(f"{folder}/missing")
    for n in ("duplicated", "mutated"):
        spark.read.parquet(f"{folder}/{n}").write.parquet(f"{tmp_path}/b/{n}")
    rows.limit(1).write.parquet(f"{tmp_path}/b/missing")
    assert "not that of the document" in verify_with_tables(doc, TEST_PUBLIC, spark, f"{tmp_path}/b")[1]
    assert verify_with_tables(resigned(spark, doc, source_commitment__merkle_root="1" * 64), TEST_PUBLIC, spark, folder)[1] == "a missing record is not in the source"


def test_golden_documents(spark):
    """Documents of other producers: every *.vrp.json of the folder that GOLDEN_DOCUMENTS names ends as its *.expected.json says."""
    folder = os.environ.get("GOLDEN_DOCUMENTS")
    if not folder:
        pytest.skip("no folder of golden documents is named")
    public = base64.b64decode(next(Path(folder).glob("*.pub.b64")).read_text().strip())
    found = sorted(Path(folder).glob("*.vrp.json"))
    assert found and public == TEST_PUBLIC
    for at in found:
        want = json.loads(at.with_name(at.name.replace(".vrp.json", ".expected.json")).read_text())
        doc = json.loads(at.read_text())
        got = verify_document(doc, public, spark)
        assert got[0] == want["verify_outcome"] and got[1] == want.get("fail_reason", "the document holds"), (at, got)
        assert form_errors(doc) == []
        rows = verify_documents(spark.createDataFrame([(at.read_text(),)], "document string"), public).collect()
        assert (rows[0].outcome, rows[0].reason) == got


def test_tolerances(spark):
    d = faults.sample_records(spark, 5)
    s = reconcile(fingerprints(d, SORTED, SALT), fingerprints(faults.duplicate(d, F.col("pos") == 2), SORTED, SALT)).summary()
    assert s.select(verdict_of(s)).first()[0] == "FAIL"
    assert s.select(verdict_of(s, Tolerances(duplicates=DuplicatePolicy.ALLOW_IF_SINK_IDEMPOTENT))).first()[0] == "PASS"
    assert s.select(verdict_of(s, reason="not read")).first()[0] == "UNVERIFIED"


def test_other_boundaries(spark):
    d = spark.range(10).withColumn("snapshot_id", F.col("id"))
    assert bounded(d, Boundary.of("BATCH_ID", {"batch_id": 3})).count() == 1
    assert max_messages(d, Boundary.of("BATCH_ID", {"max_messages": 4})).count() == 4
    assert sql_filter(d, "id > 7").count() == 2 and sql_filter(d, None).count() == 10
    with pytest.raises(InvalidBoundary):
        max_messages(d, Boundary.of("BATCH_ID", {"max_messages": -1}))
    assert bytes(spark.range(1).select(kafka_position(F.lit(258))).first()[0]) == bytes(6) + b"\1\2"


def test_chain(spark):
    docs = [{"proof_id": str(i), "created_at": f"2026-01-0{i}", "chain": {"prev_proof_hash": str(i - 1) if i != 3 else None}} for i in (1, 2, 3, 4)]
    assert chain_breaks(docs[::-1]) == ["3"]


def test_commands(spark, tmp_path, capsys):
    config = str(tmp_path / "recon.yaml")
    run = lambda *a: (cli.main([a[0], "--config", config, *a[1:]], spark), capsys.readouterr().out)
    assert run("doctor")[0] == 1 and run("verify")[0] == 1
    assert run("init", "--data-dir", str(tmp_path / "data"))[0] == 0 and "nothing" in run("init")[1]
    code, out = run("doctor")
    assert code == 0 and "FAIL" not in out
    code, out = run("reconcile", "--demo", "--metrics", str(tmp_path))
    assert code == 0 and out.startswith("PASS")
    assert "tallyglass_reconcile_total 1" in (tmp_path / "metrics.prom").read_text()
    assert run("verify", "--check") == (0, "CHECK=OK\n") and "matched     5" in run("report")[1]
    text = Path(config).read_text()
    Path(config).write_text(text.replace("table: orders", "table: orders\n  expected_schema: [order_id, nothing]"))
    assert "drifted" in run("reconcile", "--demo")[1]
    Path(config).write_text(text.replace("kms_provider: file", "kms_provider: aws\n  kms_key_id: k"))
    assert "not available" in run("reconcile", "--demo")[1]
    Path(config).write_text(text.replace("type: iceberg", "type: nothing"))
    assert run("reconcile", "--demo")[0] == 1
    assert [StoreConfig(k, bucket="b", prefix="/p/", account="a", container="c").folder() for k in ("s3", "gcs", "adls")] == ["s3a://b/p", "gs://b/p", "abfss://c@a.dfs.core.windows.net/p"]


def test_pubsub(spark):
    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            found = [{"message": {"data": base64.b64encode(b'{"a": "%d"}' % i).decode()}} for i in range(5)][: ask["maxMessages"]]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"receivedMessages": found}).encode())

        def log_message(self, *a): ...

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        d = pull(spark, "p", "s", Boundary.of("BATCH_ID", {"max_messages": 3}), f"http://127.0.0.1:{server.server_port}")
        assert [(r.offset, bytes(r.value)) for r in d.orderBy("offset").collect()] == [(i, b'{"a": "%d"}' % i) for i in range(3)]
    finally:
        server.shutdown()


def test_streams(spark, tmp_path):
    d = spark.sql("select id, cast('2026-01-01 00:00:00' as timestamp) + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts, concat('v', id) as v from range(20)")
    d.write.parquet(str(tmp_path / "in"))
    policy = Policy("field:id", ("id", "v"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = []
    q = reconcile_stream(stream, lambda n: d.where("id != 7"), policy, SALT, lambda n, r: got.append(r.summary().first()), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert [(s.source_count, s.missing) for s in got] == [(20, 1)]
    w = windowed_commitment(stream, policy, SALT, "ts", "10 minutes")
    q = w.writeStream.outputMode("complete").format("memory").queryName("commitments").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["count"] for r in spark.table("commitments").collect()) == [10, 10]
