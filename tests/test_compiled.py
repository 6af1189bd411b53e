"""What is hashed is code that the JVM compiles."""

import re

from pyspark.sql import functions as F

from tallyglass.functions.canon import u32
from tallyglass.functions.hashing import fingerprints
from tallyglass.plans.queries import LINE_ORDER, LINES, ORDERS, SALT

#: HotSpot interprets methods of more bytes, some times slower, unless it is told otherwise.
HUGE = 8000


def test_generated_methods_are_small_enough_to_be_compiled(spark, tmp_path):
    orders = spark.range(1).selectExpr("id o_orderkey", "id o_custkey", "'O' o_orderstatus", "1.5d o_totalprice", "timestamp_ntz'2020-01-01' o_orderdate", "'1-URGENT' o_orderpriority", "id pos")
    lines = spark.range(1).selectExpr("id l_orderkey", "1 l_linenumber", "id l_partkey", "id l_suppkey", "1d l_quantity", "2d l_extendedprice", "0d l_discount", "0d l_tax", "'A' l_returnflag", "timestamp_ntz'2020-01-01' l_shipdate")
    orders.write.parquet(f"{tmp_path}/orders")
    lines.write.parquet(f"{tmp_path}/lines")
    orders, lines = spark.read.parquet(f"{tmp_path}/orders"), spark.read.parquet(f"{tmp_path}/lines").withColumn("pos", F.struct(*LINE_ORDER))
    settings = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        for rows, policy in ((orders, ORDERS), (lines, LINES)):
            x = fingerprints(rows, policy, SALT).select("id_hash", "content_hash", "pos")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(x._jdf.queryExecution().executedPlan()))]
            assert sizes and max(sizes) < HUGE
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lengths(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 127, 128, 255, 256, 65_536, 1 << 30, None)], "n long").select("n", u32(F.col("n")).alias("b"), u32(F.col("n") % 256, short=True).alias("s")).collect()
    assert [(bytes(r.b), bytes(r.s)) for r in got if r.n is not None] == [(r.n.to_bytes(4, "big"), (r.n % 256).to_bytes(4, "big")) for r in got if r.n is not None] and got[-1].b is None


def test_doubles_are_cut_not_rounded(spark):
    from tallyglass.functions.canon import double_decimal

    values = [0.0, -0.0, 1.9999999, -1.9999999, 0.1, 1e-7, 123456789.125, -5.0, 1e25, None, float("1e19")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(*(double_decimal(F.col("v"), s).alias(f"s{s}") for s in (6, 0, 20))).collect()
    assert [r.s6 for r in got] == ["0.000000", "0.000000", "1.999999", "-1.999999", "0.100000", "0.000000", "123456789.125000", "-5.000000", "1" + "0" * 25 + ".000000", None, "1" + "0" * 19 + ".000000"]
    assert [r.s0 for r in got][2:5] == ["1", "-1", "0"] and got[4].s20 == "0.10000000000000000000"
