"""Scan of raw trip CSV files."""

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hackney.schemas import TRIP_COLUMNS
from hackney.sources.storage import literal

# Texts that mean "missing" in the input files.
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Takes a field beyond the header's last, if a row has one.
BEYOND = T.StructField("_beyond", T.StringType())


class HeaderError(ValueError):
    """The header names something that is no trip column."""


def header_columns(header: str) -> list[str]:
    """The columns a header line names, in its order; some may be missing."""
    names = next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")]), [])
    unknown = sorted({n for n in names if n not in TRIP_COLUMNS or names.count(n) > 1})
    if unknown or not names:
        raise HeaderError(f"header with columns that are unknown or doubled: {unknown}")
    return names


def split_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings in which a task reads one split of one file.

    Opening a file costs as much as a whole split there, so splits are never packed, and
    where they lie follows from the file and ``maxPartitionBytes`` alone, not from the
    cores at hand: two scans number rows alike. All columns are parsed in both.
    """
    work = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name) or not name.startswith("spark."):
            work.conf.set(name, value)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    work.conf.set("spark.sql.files.openCostInBytes", size)
    work.conf.unset("spark.sql.files.maxPartitionNum")
    work.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")
    return work


def read_trip_csv(
    spark: SparkSession, paths: list[str], columns: list[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """Trip rows as text, plus where each row lies, of files with the same header.

    ``columns`` are those of the header; trip columns it lacks are NULL. The scan
    is splittable unless ``multi_line`` is set (quoted line breaks). ``too_long``
    marks a row with more fields than the header, quotes respected; one with
    fewer ends in NULLs. ``_split_start`` and ``_split_row``, the place from 0 in the
    split, order the rows of a file; the session is one of ``split_session``.
    """
    columns = columns or TRIP_COLUMNS
    fields = [T.StructField(c, T.StringType()) for c in columns]
    scan = (
        spark.read.schema(T.StructType([*fields, BEYOND]))
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", multi_line)
        # No text stands for NULL here: a field that is there differs from none.
        .option("nullValue", "\0")
        .csv([literal(path) for path in paths])
    )
    texts = [
        F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)).alias(c)
        if c in columns
        else F.lit(None).cast("string").alias(c)
        for c in TRIP_COLUMNS
    ]
    return scan.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_split_start"),
        # The lower 33 bits count the rows of a task, which reads one split.
        F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("_split_row"),
        F.col(BEYOND.name).isNotNull().alias("too_long"),
        *texts,
    )
