import pytest
from pyspark.sql import SparkSession

#: Tables here have some hundred rows: compiling a stage takes longer than running it without.
SETTINGS = {
    "spark.sql.shuffle.partitions": "4",
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    b = SparkSession.builder.master("local[4]").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
