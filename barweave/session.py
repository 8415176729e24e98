"""Session settings and the shared scratch folder."""

import uuid

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Options of our own sessions: dates are compared as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cpus: str = "*", app: str = "barweave") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        # Recording the call site of every column operation slows plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return tune(spark)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in a folder that all executors share.

    `spark.checkpoint.dir` where it is set, else the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
