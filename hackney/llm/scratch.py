"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only where the session names no such folder and runs on one machine (tests) one is
    made locally and set as the session's checkpoint folder; elsewhere that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="hackney-shared-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/hackney-{uuid.uuid4().hex}"


#: Rows of a batch that a task hands to Python; batches hold whole texts.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size, so that workers hold few texts at a time."""
    rows = int(spark.conf.get(_BATCH_SETTING, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def stage(spark: SparkSession, df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read again: survives lost executors."""
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run here go as it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP_SETTING, "false")
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_SETTING, before)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
