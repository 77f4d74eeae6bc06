"""Raw batches from an external database, read in parallel."""

from pyspark.sql import DataFrame, SparkSession

from hackney.schemas import TRIP_COLUMNS

BATCH_COLUMNS = ["batch_no", "source_file", "file_hash", *TRIP_COLUMNS]


def batch_query(table: str, batches: list[int]) -> str:
    """The pruned and filtered subquery for a set of batches."""
    numbers = ", ".join(str(int(b)) for b in batches)
    columns = ", ".join(BATCH_COLUMNS)
    return f"(SELECT {columns} FROM {table} WHERE batch_no IN ({numbers})) AS raw_batch"


def read_raw_batches(
    spark: SparkSession,
    url: str,
    table: str,
    batches: list[int],
    properties: dict[str, str],
    partitions: int = 8,
) -> DataFrame:
    """Rows of ``batches``, one query per range of batch numbers."""
    low, high = min(batches), max(batches)
    return spark.read.jdbc(
        url,
        batch_query(table, batches),
        column="batch_no",
        lowerBound=low,
        upperBound=high + 1,
        numPartitions=min(partitions, high - low + 1),
        properties=properties,
    )
