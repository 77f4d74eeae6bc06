"""Session helpers for jobs and tests that do not bring their own session."""

import os

from pyspark.sql import SparkSession


def local_session(app_name: str = "hackney", cpus: str = "*") -> SparkSession:
    """A local session with the settings the library is tuned and tested with."""
    spark = (
        SparkSession.builder.appName(app_name)
        .master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HACKNEY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
