import json

import pytest
from pyspark.sql import functions as F

from tallyglass.functions.model import Boundary, ConnectorError, InvalidBoundary
from tallyglass.sources import segments
from tallyglass.sources.completeness import offset_gaps


def boundary(*parts):
    return Boundary.of("OFFSET_RANGE", {"partitions": [{"id": p, "start": a, "end": z} for p, a, z in parts]})


def rows_of(df):
    return sorted((r.partition, r.offset, None if r.value is None else bytes(r.value)) for r in df.collect())


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Three partitions, one with a gap over whole segments, one with large offsets, repeated and null values."""
    rows = [(0, i, f"v{i}") for i in range(95)] + [(1, i, None) for i in range(40) if not 8 <= i < 27] + [(5, 10**12 + i, "x") for i in range(3)] + [(0, 3, "again")]
    path = f"file://{tmp_path_factory.mktemp('log')}/log"
    segments.write_segments(spark.createDataFrame(rows, "partition int, offset long, value string"), path, segment=10)
    return path, sorted((p, o, None if v is None else v.encode()) for p, o, v in rows)


def test_batches_against_a_plain_filter(spark, log):
    path, rows = log
    read = lambda b=None: segments.read_segments(spark, path, b, segment=10, task=2)
    assert rows_of(read()) == rows
    b = boundary((0, 7, 58), (1, 0, 30), (9, 0, 99))
    inside = [r for r in rows if r[0] == 0 and 7 <= r[1] <= 58 or r[0] == 1 and r[1] <= 30]
    assert rows_of(read(b)) == inside
    assert rows_of(read(b).where("offset > 20 and offset <= 41 and partition = 0")) == [r for r in inside if r[0] == 0 and 20 < r[1] <= 41]
    assert rows_of(read(b).where("partition in (1, 9) and offset != 4 and value is null")) == [r for r in inside if r[0] == 1 and r[1] != 4]
    assert rows_of(read(b).where("offset < 5 or partition = 1")) == [r for r in inside if r[1] < 5 or r[0] == 1]
    assert rows_of(read(boundary((0, 90, 10**17)))) == [r for r in rows if r[0] == 0 and r[1] >= 90]  # an open end
    assert rows_of(read(b).where("offset < 3 and offset > 8")) == rows_of(read(boundary((0, 9, 2)))) == rows_of(read(boundary())) == []
    assert [(r.partition, r.first, r.last) for r in offset_gaps(read(boundary((1, 0, 39))), boundary((1, 0, 39))).collect()] == [(1, 8, 26)]


def test_conditions_decide_the_ranges(spark, log):
    path, _ = log
    x = segments.read_segments(spark, path, boundary((0, 0, 94), (1, 0, 39)), segment=10, task=2)
    assert x.rdd.getNumPartitions() == 5 + 2
    assert x.where("partition = 0 and offset between 25 and 45").rdd.getNumPartitions() == 2
    assert x.where("partition = 0 and offset >= 80").select(F.spark_partition_id()).distinct().count() == 1
    r = segments._Batch({"path": path, "segment": "10", "task": "2", "boundary": json.dumps([{"id": 0, "start": 0, "end": 94}])})
    assert list(r.pushFilters([segments.GreaterThan(("offset",), 11), segments.LessThan(("offset",), 20), segments.EqualTo(("value",), b"v")])) == [segments.EqualTo(("value",), b"v")]
    assert r.partitions() == [segments.Range(0, 12, 19)]
    # a lost task reads its own range again, with the same rows
    again = [[b.to_pydict() for b in r.read(segments.Range(0, 12, 19))] for _ in range(2)]
    assert again[0] == again[1] and [o for b in again[0] for o in b["offset"]] == list(range(12, 20))


def test_stream_goes_on_from_its_position(spark, tmp_path):
    path, out, state = (f"file://{tmp_path}/{x}" for x in ("log", "out", "state"))
    make = lambda p, a, z: spark.createDataFrame([(p, i, f"{p}-{i}") for i in range(a, z)], segments.SCHEMA.replace("binary", "string"))

    def run(b=None):
        s = segments.read_segments(spark, path, b, segment=10, stream=True)
        s.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return rows_of(spark.read.schema(segments.SCHEMA).parquet(out))

    segments.write_segments(make(0, 0, 25), path, segment=10)
    assert run() == sorted((0, i, f"0-{i}".encode()) for i in range(25))
    more = make(0, 25, 33).unionByName(make(4, 0, 12))
    more.withColumns({"value": F.col("value").cast("binary"), "segment": F.floor(F.col("offset") / 10)}).write.mode("append").partitionBy("partition", "segment").parquet(path)
    want = sorted([(0, i, f"0-{i}".encode()) for i in range(33)] + [(4, i, f"4-{i}".encode()) for i in range(12)])
    assert run() == want  # nothing twice
    assert run() == want


def test_empty_logs_and_errors(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    segments.write_segments(spark.createDataFrame([], "partition int, offset long, value string"), path)
    assert rows_of(segments.read_segments(spark, path)) == rows_of(segments.read_segments(spark, f"file://{tmp_path}/absent")) == []
    for b in (boundary((0, 1, 2), (0, 4, 5)), boundary((0, -1, 2)), Boundary.of("OFFSET_RANGE", {"partitions": [{"id": 1}]})):
        with pytest.raises(InvalidBoundary):
            segments.read_segments(spark, path, b)
    with pytest.raises(ConnectorError):
        segments._Segments({"path": path, "segment": "0"})
    with pytest.raises(Exception, match="without offset"):
        segments.write_segments(spark.createDataFrame([(1, None, "x")], "partition int, offset long, value string"), f"file://{tmp_path}/bad")
