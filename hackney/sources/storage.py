"""Paths on the cluster's shared file system, through Hadoop's own client."""

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.range(0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def control_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few driver-side rows as a local relation, whose size Catalyst knows."""
    columns = {name: [row[n] for row in rows] for n, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at ``path``, or no rows while it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_rows(spark, schema)


def append_small(rows: DataFrame, path: str) -> None:
    """Append a control table's few rows as one file, so they appear together."""
    # One file by a shuffle of these few rows: what computes them stays parallel.
    rows.repartition(1).write.mode("append").parquet(path)


def literal(path: str) -> str:
    """``path`` with the characters escaped that Spark reads as a pattern."""
    return re.sub(r"([\\\\*?\[\]{}])", r"\\\1", path)


def hidden_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Files below ``path`` whose suffix fits but which no Spark source lists.

    Those are names that begin with ``_`` or ``.``, and whatever lies in folders of
    such names. Level by level, only such names come to Python.
    """
    files, target = _hadoop(spark, path)
    if not files.exists(target) or files.getFileStatus(target).isFile():
        return []
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    found, level = [], literal(path.rstrip("/"))

    def fits(name: str) -> bool:
        return name.lower().endswith(suffix)

    while len(files.globStatus(jpath(f"{level}/*"))):
        for entry in files.globStatus(jpath(f"{level}/{{_,.}}*")):
            if entry.isFile():
                found += [entry.getPath().toString()] * fits(entry.getPath().getName())
                continue
            below = files.listFiles(entry.getPath(), True)
            while below.hasNext():
                child = below.next().getPath()
                found += [child.toString()] * fits(child.getName())
        level += "/[!_.]*"
    return sorted(found)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def child_directories(spark: SparkSession, path: str) -> list[str]:
    """``key=value`` directories right below ``path``."""
    files, target = _hadoop(spark, path)
    if not files.exists(target):
        return []
    found = [entry.getPath() for entry in files.listStatus(target) if entry.isDirectory()]
    return [child.toString() for child in found if "=" in child.getName()]


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Data files right below ``path``; markers and checksums aside."""
    files, target = _hadoop(spark, path)
    found = [entry.getPath() for entry in files.listStatus(target) if entry.isFile()]
    return [child.toString() for child in found if child.getName()[0] not in "_."]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a directory this library wrote itself."""
    files, target = _hadoop(spark, path)
    files.delete(target, True)
