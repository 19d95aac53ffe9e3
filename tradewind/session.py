"""A local session for tests and the benchmark. On a cluster, use the session you already have."""

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "tradewind", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tradewind-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
