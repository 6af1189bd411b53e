"""Tables with a Delta log: every version against a plain replay in Python."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyglass.functions.model import Boundary, ConnectorError, InvalidBoundary
from tallyglass.sources.connectors import build_sink
from tallyglass.sources.delta import LOG, DeltaTable

ROWS = "k long, p string, t timestamp, s string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def bag(df):
    return sorted(map(str, df.select("k", "p", "t", "s").collect()))


def made(spark, folder, partitions):
    """A table of random adds and removes with a checkpoint on the way, and each version's rows by a plain replay."""
    g = random.Random(5)
    t = DeltaTable(spark, str(folder))
    at = datetime.datetime(2020, 1, 1, 0, 0, 0, 123456)
    held, want, key = {}, [], 0
    for v in range(5):
        rows = [(key + i, g.choice(["a b", "c/d", "é=%", None]), at + datetime.timedelta(microseconds=key + i) if g.random() < 0.8 else None, g.choice(["x", "", None])) for i in range(20)]
        key += 20
        gone = None
        if v in (2, 4):
            lost = g.sample(sorted(held), len(held) // 2)
            gone = spark.createDataFrame([(x,) for x in lost], "path string")
            held = {p: r for p, r in held.items() if p not in lost}
        t.commit(frame(spark, rows).repartition(2), gone, partitions)
        for action in t.actions().where(f"version = {v} and add is not null").collect():
            held[action.add.path] = json.loads(action.add.stats)
        held_keys = {r.path for r in t.files(v).collect()}
        assert held_keys == set(held)
        want.append(sum(s["numRecords"] for s in held.values()))
        if v == 2:
            assert t.checkpoint() == 2
    return t, want


@pytest.mark.parametrize("partitions", [(), ("p",)])
def test_versions_before_and_after_a_checkpoint(spark, tmp_path, partitions):
    t, want = made(spark, tmp_path / "a table+é", partitions)
    assert [t.read(v).count() for v in range(5)] == want
    assert t.read(0).columns == ["k", "p", "t", "s", "pos", "pos_text"]
    assert {r.p for r in t.read().collect()} == {"a b", "c/d", "é=%", None}
    at = t.read(3).select("pos").collect()
    assert len({(r.pos.file, r.pos.row) for r in at}) == want[3]
    # the commits that the checkpoint stands for may go; later versions stay as they were, earlier ones are an error
    before = bag(t.read(4))
    for v in (0, 1):
        t.store.fs.delete(t.store.path(f"{LOG}/{v:020d}.json"), False)
    assert bag(DeltaTable(spark, t.base).read(4)) == before and t.read(2).count() == want[2]
    with pytest.raises(ConnectorError, match="lacks version 0"):
        t.read(1)
    with pytest.raises(ConnectorError):
        t.read(9)


@pytest.mark.parametrize("partitions", [(), ("p",)])
def test_files_are_skipped_and_no_row_is_lost(spark, tmp_path, partitions):
    t, _ = made(spark, tmp_path, partitions)
    rows = t.read()
    last = rows.agg(F.max("t")).first()[0]
    for ranges, where in [
        ({"k": (30, 50)}, "k between 30 and 50"),
        ({"k": (None, 70), "p": ("c/d", "c/d")}, "k <= 70 and p = 'c/d'"),
        ({"t": (last, None)}, F.col("t") >= F.lit(last)),
        ({"s": ("", "w")}, "s between '' and 'w'"),
        ({"p": ("zz", None)}, "p >= 'zz'"),
        ({"s": (None, None)}, "s is not null"),
    ]:
        assert bag(t.read(ranges=ranges)) == bag(rows.where(where)), ranges
    assert t.files(ranges={"k": (1000, None)}).count() == 0 and t.read(ranges={"k": (1000, None)}).count() == 0
    assert t.files(ranges={"k": (0, 0)}).count() < t.files().count()
    with pytest.raises(InvalidBoundary, match="no such column"):
        t.files(ranges={"none": (0, 1)})


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    with pytest.raises(ConnectorError, match="no log"):
        DeltaTable(spark, str(tmp_path / "none")).read()
    t = DeltaTable(spark, str(tmp_path / "t"))
    with pytest.raises(ConnectorError, match="first version"):
        t.commit()
    d = frame(spark, [(1, "a", None, "x"), (1, "a", None, "x")])
    t.commit(d)
    with pytest.raises(ConnectorError, match="other columns"):
        t.commit(d.select("k"))
    with pytest.raises(ConnectorError, match="may be there already"):
        t.store.create(f"{LOG}/{0:020d}.json", b"")
    path = t.files().first().path
    stated = lambda add: t.store.create(f"{LOG}/{t.latest() + 1:020d}.json", json.dumps({"add": {"path": path, "partitionValues": {}, "size": 1} | add}).encode())
    stated({})  # the same file again, without statistics: still once
    assert t.read(ranges={"k": (5, 6)}).count() == 0 and t.files(ranges={"k": (5, 6)}).count() == 1 and t.read().count() == 2
    stated({"path": "s3://elsewhere/x.parquet"})
    with pytest.raises(ConnectorError, match="outside"):
        t.read()
    assert t.read(1).count() == 2
    t.commit(remove=spark.createDataFrame([("s3://elsewhere/x.parquet",)], "path string"))
    stated({"deletionVector": {"storageType": "u", "pathOrInlineDv": "x"}})
    with pytest.raises(Exception, match="deletion vector"):
        t.read()
    t.store.create(f"{LOG}/{t.latest() + 1:020d}.json", json.dumps({"metaData": {"id": "i", "schemaString": d.schema.json(), "partitionColumns": [], "configuration": {"delta.columnMapping.mode": "name"}}}).encode())
    with pytest.raises(ConnectorError, match="columnMapping"):
        t.schema()


def test_a_table_as_a_sink(spark, tmp_path):
    t = build_sink(spark, {"type": "delta", "warehouse": str(tmp_path), "table": "orders"})
    d = frame(spark, [(i, "a", None, None) for i in range(4)])
    t.commit(d.withColumn("pos", F.lit(7)).drop("pos"))
    t.commit(remove=t.files())
    assert t.field_names() == ["k", "p", "t", "s"] and t.rows().count() == 0
    assert t.rows(Boundary.of("BATCH_ID", {"snapshot_from": 0, "snapshot_to": 0})).count() == 4
    with pytest.raises(InvalidBoundary):
        t.rows(Boundary.of("BATCH_ID", {"snapshot_from": 1, "snapshot_to": 3}))
