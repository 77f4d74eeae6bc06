"""Set operations that decide what an incremental run still has to do."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.operators.intervals import as_numbers, as_ranges, pending_ranges
from hackney.operators.latest import first_by_key


def first_delivery(files: DataFrame, order: str = "path") -> DataFrame:
    """One row per (file_name, file_hash): the first by ``order``."""
    return first_by_key(files, ["file_name", "file_hash"], F.col(order).asc())


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose name and content are not in the ledger yet."""
    known = ledger.select("file_name", "file_hash")
    return files.join(known, ["file_name", "file_hash"], "left_anti")


def distinct_batches(rows: DataFrame) -> DataFrame:
    return rows.select("batch_no").distinct()


def pending_batches(batches: DataFrame, processed: DataFrame) -> DataFrame:
    """Batches that no entry of ``processed`` covers."""
    return as_numbers(pending_ranges(as_ranges(batches), as_ranges(processed)))


def max_batch_no(rows: DataFrame) -> DataFrame:
    """One row: the highest batch number, 0 when there is none."""
    return rows.agg(F.coalesce(F.max("batch_no"), F.lit(0)).alias("max_batch_no"))


def insert_if_absent(ledger: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """The entries an insert that ignores conflicts would add."""
    return entries.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")
