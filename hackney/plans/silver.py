"""Silver layer: pending raw batches, typed, validated and merged by trip id."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hackney.operators.intervals import Ranges, as_numbers, pending_ranges
from hackney.operators.latest import latest_by_key, repeated_keys
from hackney.operators.validation import clean, validate
from hackney.plans.ingest import check_load_mode, committed_batches, transactions_raw
from hackney.schemas import BATCH_LOG, BATCH_RANGES, SILVER
from hackney.sources.storage import append_small, control_rows, delete_path, read_or_empty
from hackney.sources.tables import KeyedTable


def silver_table(
    spark: SparkSession,
    warehouse: str,
    buckets: int = 64,
    parts: int = 1,
    key_filters: bool = False,
) -> KeyedTable:
    path = f"{warehouse}/silver/transactions_clean"
    return KeyedTable(spark, path, SILVER, ["id"], buckets, parts, key_filters)


def logged_ranges(spark: SparkSession, warehouse: str, layer: str = "silver") -> DataFrame:
    """The processed batches as the log holds them: disjoint ranges with their time.

    Logs that name every batch, as they did before, count as well.
    """
    single = read_or_empty(spark, f"{warehouse}/{layer}/batch_log", BATCH_LOG)
    ranges = read_or_empty(spark, f"{warehouse}/{layer}/batch_ranges", BATCH_RANGES)
    number = [F.col("batch_no").alias(end) for end in ("first_batch", "last_batch")]
    return ranges.unionByName(single.select(*number, "processed_at"))


def batch_log(spark: SparkSession, warehouse: str, layer: str = "silver") -> DataFrame:
    """One row per processed batch: batch_no, processed_at."""
    numbers = F.explode(F.sequence("first_batch", "last_batch")).alias("batch_no")
    return logged_ranges(spark, warehouse, layer).select(numbers, "processed_at")


def log_batches(
    spark: SparkSession, warehouse: str, batches: DataFrame, layer: str = "silver"
) -> None:
    """Mark ranges of batches as processed; ones already in the log stay as they are."""
    entries = pending_ranges(batches, logged_ranges(spark, warehouse, layer))
    append_small(
        entries.withColumn("processed_at", F.current_timestamp()),
        f"{warehouse}/{layer}/batch_ranges",
    )


def silver_rows(raw: DataFrame) -> DataFrame:
    """Raw rows typed and judged: the silver columns plus ``raw_id``."""
    judged = validate(clean(raw)).withColumn("updated_at", F.current_timestamp())
    return judged.select("raw_id", *SILVER.names)


def latest_valid(judged: DataFrame) -> DataFrame:
    """Per id the valid row of the latest batch, and in it the last one."""
    order = ["batch_no", "raw_id"]
    return latest_by_key(judged, ["id"], order, where=F.col("is_valid")).drop("raw_id")


def rejects(spark: SparkSession, warehouse: str) -> DataFrame:
    """Every raw row that broke a rule, with the reasons."""
    return silver_rows(transactions_raw(spark, warehouse)).where("NOT is_valid")


def build_silver(
    spark: SparkSession,
    warehouse: str,
    load_mode: str = "incremental",
    buckets: int = 64,
    strict: bool = False,
    parts: int = 1,
    key_filters: bool = False,
) -> Ranges:
    """Merge all pending batches in one pass; returns their numbers, ascending.

    They come to the driver as ranges. ``full`` takes every batch again. With ``strict`` an id that occurs twice
    among the valid rows of one batch is an error instead of a last-row win.
    """
    check_load_mode(load_mode)
    batches = committed_batches(spark, warehouse)
    done = logged_ranges(spark, warehouse)
    # Fixed once, so that the rows merged and the batches logged are the same.
    wanted = pending_ranges(batches, done if load_mode == "incremental" else done.limit(0))
    numbers = Ranges(map(tuple, wanted.collect()))
    if not numbers:
        return numbers
    ends = [(part.start, part.stop - 1) for part in numbers.ranges]
    wanted = control_rows(spark, ends, ["first_batch", "last_batch"]).select(
        *[F.col(end).cast("int") for end in ("first_batch", "last_batch")]
    )

    # The numbers themselves stay in files, so that Catalyst sees their real size.
    path = f"{warehouse}/silver/stage/pending"
    as_numbers(wanted).write.mode("overwrite").parquet(path)
    pending = spark.read.parquet(path)
    # A load's batches follow each other, and no other load has numbers between them.
    loads = batches.groupBy("load_id").agg(
        F.min("first_batch").alias("first_batch"), F.max("last_batch").alias("last_batch")
    )
    near = [r.load_id for r in loads.collect() if numbers.overlap(r.first_batch, r.last_batch)]
    raw = transactions_raw(spark, warehouse, near).where(
        F.col("batch_no").between(ends[0][0], ends[-1][1])
    )
    judged = silver_rows(raw.join(pending, "batch_no", "left_semi"))
    if strict:
        twice = repeated_keys(judged.where("is_valid"), ["batch_no", "id"]).first()
        if twice:
            raise ValueError(f"id {twice.id!r} occurs twice in batch {twice.batch_no}")
    silver_table(spark, warehouse, buckets, parts, key_filters).merge(latest_valid(judged))
    log_batches(spark, warehouse, wanted)
    delete_path(spark, path)
    return numbers
