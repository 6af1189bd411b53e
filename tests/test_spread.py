"""Which tables are dealt out before they are hashed."""

from tallyglass.functions.hashing import spread


def test_tables_that_a_scan_deals_out_are_not_exchanged(spark, tmp_path):
    rows = spark.range(200_000, numPartitions=2).selectExpr("id", "uuid() v")
    rows.write.parquet(f"{tmp_path}/t")
    table, old = spark.read.parquet(f"{tmp_path}/t"), spark.conf.get("spark.sql.files.openCostInBytes")
    plan = lambda: spread(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan()
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        assert "Repartition" not in plan()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
