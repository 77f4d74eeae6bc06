"""File arrivals through Structured Streaming.

The stream announces paths it has not seen; the ledger still decides whether a file is
new. What a stream never announces again is looked up when a run begins: files
rewritten in place, by the states of files read before, and files that could
not be loaded, by the log of failures. Both then take the way of arrivals.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hackney.plans.gold import build_gold
from hackney.plans.ingest import (
    DEFAULT_CHUNK_SIZE,
    HIDDEN,
    IngestResult,
    file_states,
    ingest_files,
)
from hackney.plans.silver import build_silver
from hackney.sources.files import discover_csv, listed, rewritten
from hackney.sources.storage import (
    append_small,
    control_rows,
    hidden_files,
    literal,
    read_or_empty,
)

# The fixed schema of Spark's binaryFile source.
BINARY_FILE = (
    "path string, modificationTime timestamp, length bigint, content binary"
)
# One row for each time a file failed; no reason once it is no longer open.
FAILURES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("noted_at", T.TimestampType()),
    ]
)


def csv_arrivals(
    spark: SparkSession, source: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A stream of the listing columns of arriving CSV files."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("recursiveFileLookup", "true")
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return listed(reader.load(literal(source)))


def failed_arrivals(spark: SparkSession, warehouse: str) -> DataFrame:
    """(path, reason, noted_at) of files that arrived and are not loaded yet."""
    log = read_or_empty(spark, f"{warehouse}/raw/failed_arrivals", FAILURES)
    last = log.groupBy("path").agg(F.max_by(F.struct("reason", "noted_at"), "noted_at").alias("last"))
    return last.select("path", "last.*").where("reason IS NOT NULL")


def overdue(spark: SparkSession, source: str, warehouse: str) -> DataFrame:
    """Files below ``source`` that failed before, or were rewritten since they were read."""
    files = discover_csv(spark, source)
    failed = failed_arrivals(spark, warehouse).select("path")
    again = files.join(failed, "path", "left_semi")
    changed = rewritten(files, file_states(spark, warehouse))
    return again.unionByName(changed).distinct()


def _note(
    spark: SparkSession, warehouse: str, failed: dict[str, str], done: list[str]
) -> None:
    """Appends what changed: new failures and reasons, and failures that are settled."""
    still = {row.path: row.reason for row in failed_arrivals(spark, warehouse).collect()}
    rows = [(path, reason) for path, reason in failed.items() if still.get(path) != reason]
    rows += [(path, None) for path in done if path in still]
    if rows:
        log = control_rows(spark, rows, ["path", "reason"]).select(
            "path",
            F.col("reason").cast("string").alias("reason"),
            F.current_timestamp().alias("noted_at"),
        )
        append_small(log, f"{warehouse}/raw/failed_arrivals")


def process_arrivals(
    spark: SparkSession,
    source: str,
    warehouse: str,
    checkpoint: str,
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    buckets: int = 64,
    parts: int = 1,
    max_files_per_trigger: int | None = None,
    after_load: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Process all files that have arrived, then stop (``availableNow``).

    Files that cannot be loaded stay in ``failed_arrivals`` with the reason, and every run
    tries them again, as it does files rewritten in place. ``after_load`` gets the number
    of each batch of the stream.
    """

    def load(files: DataFrame, batch_id: int) -> None:
        session = files.sparkSession
        result: IngestResult = ingest_files(
            session, files, warehouse, "incremental", chunk_size
        )
        _note(
            session,
            warehouse,
            result.failed_files,
            [*result.processed_files, *result.skipped_files],
        )
        build_silver(session, warehouse, "incremental", buckets, parts=parts)
        build_gold(session, warehouse, "incremental", buckets, parts)
        if after_load and batch_id >= 0:
            after_load(batch_id)

    hidden = dict.fromkeys(hidden_files(spark, source, ".csv"), HIDDEN)
    named = failed_arrivals(spark, warehouse).where(F.col("reason") == HIDDEN).collect()
    _note(spark, warehouse, hidden, [row.path for row in named if row.path not in hidden])
    late = overdue(spark, source, warehouse)
    if not late.isEmpty():
        load(late, -1)
    return (
        csv_arrivals(spark, source, max_files_per_trigger)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
