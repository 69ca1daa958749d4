"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

INPUT_PARTS = "spark.postlens.inputParts"

REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on; cluster sizing stays with the caller."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "postlens", **extra: str) -> SparkSession:
    """A session for tests and the bench, whose tables have one row group each."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config(INPUT_PARTS, "8" if cores == "*" else cores)
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
