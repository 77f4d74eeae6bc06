"""Gold layer: a small star schema over the valid silver rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hackney.operators.intervals import as_numbers, pending_ranges
from hackney.plans.ingest import check_load_mode
from hackney.plans.silver import log_batches, logged_ranges, silver_table
from hackney.schemas import DIM_DATE, DIM_VENDOR, FACT_TRIPS, SILVER
from hackney.sources.storage import append_small, control_rows, delete_path, read_or_empty
from hackney.sources.tables import KeyedTable

SEEN = T.StructType([T.StructField("version", T.IntegerType())])

# Fixed: the columns of the report, in order.
REPORT_COLUMNS = [
    "id",
    "year",
    "month",
    "day",
    "vendor_id",
    "pickup_datetime",
    "dropoff_datetime",
    "passenger_count",
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
    "store_and_fwd_flag",
    "trip_duration",
]


def dim_vendor_rows(silver: DataFrame) -> DataFrame:
    vendors = silver.where("is_valid AND vendor_id IS NOT NULL").select("vendor_id")
    return vendors.distinct().withColumn("updated_at", F.current_timestamp())


def dim_date_rows(silver: DataFrame) -> DataFrame:
    # The parts follow from the date, so only the date is made distinct.
    dates = (
        silver.where("is_valid AND pickup_datetime IS NOT NULL")
        .select(F.to_date("pickup_datetime").alias("date_id"))
        .distinct()
    )
    return dates.select(
        "date_id",
        F.year("date_id").alias("year"),
        F.month("date_id").alias("month"),
        F.dayofmonth("date_id").alias("day"),
    )


def fact_rows(silver: DataFrame) -> DataFrame:
    return (
        silver.where("is_valid AND id IS NOT NULL AND id <> ''")
        .withColumn("date_id", F.to_date("pickup_datetime"))
        .withColumn("updated_at", F.current_timestamp())
        .select(*FACT_TRIPS.names)
    )


def dim_vendor(spark: SparkSession, warehouse: str) -> KeyedTable:
    path = f"{warehouse}/gold/dim_vendor"
    return KeyedTable(spark, path, DIM_VENDOR, ["vendor_id"], buckets=1)


def dim_date(spark: SparkSession, warehouse: str) -> KeyedTable:
    path = f"{warehouse}/gold/dim_date"
    return KeyedTable(spark, path, DIM_DATE, ["date_id"], buckets=1)


def fact_trips(
    spark: SparkSession,
    warehouse: str,
    buckets: int = 64,
    parts: int = 1,
    key_filters: bool = False,
) -> KeyedTable:
    path = f"{warehouse}/gold/fact_trips"
    return KeyedTable(spark, path, FACT_TRIPS, ["id"], buckets, parts, key_filters)


def build_gold(
    spark: SparkSession,
    warehouse: str,
    load_mode: str = "incremental",
    buckets: int = 64,
    parts: int = 1,
    key_filters: bool = False,
) -> bool:
    """Bring the star schema up to date; False when there was nothing to do.

    ``incremental`` takes the silver rows of batches gold has not seen yet; a
    silver row an older batch wrote is already in the fact table. ``full``
    takes every silver row. Silver is read once, down to the files its versions
    since gold's last run have written; the three targets share those rows.
    """
    check_load_mode(load_mode)
    table = silver_table(spark, warehouse, buckets)
    version = table.version()
    done = logged_ranges(spark, warehouse)
    if load_mode == "incremental":
        done = pending_ranges(done, logged_ranges(spark, warehouse, "gold"))
        if done.isEmpty():
            return False
        changed = table.read(after=seen_version(spark, warehouse))
        silver = changed.join(as_numbers(done), "batch_no", "left_semi")
    else:
        silver = table.read()
    stage = f"{warehouse}/gold/stage/silver"
    silver.write.mode("overwrite").parquet(stage)
    silver = spark.read.schema(SILVER).parquet(stage)
    dim_vendor(spark, warehouse).merge(dim_vendor_rows(silver))
    dim_date(spark, warehouse).merge(dim_date_rows(silver))
    fact_trips(spark, warehouse, buckets, parts, key_filters).merge(fact_rows(silver))
    log_batches(spark, warehouse, done, "gold")
    # After the batches: a run that dies before it reads those versions again.
    append_small(
        control_rows(spark, [(version,)], ["version"]).select(F.col("version").cast("int")),
        f"{warehouse}/gold/silver_versions",
    )
    delete_path(spark, stage)
    return True


def seen_version(spark: SparkSession, warehouse: str) -> int:
    """The newest silver version that gold has taken in; 0 before the first."""
    log = read_or_empty(spark, f"{warehouse}/gold/silver_versions", SEEN)
    return log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v


def v_trip_report(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Trips with the parts of their date; needs the date in ``dates``.

    Without a hint: Catalyst broadcasts the dimension when its stored size
    allows, and otherwise joins by shuffle, where adaptive execution splits a
    day that holds most trips.
    """
    return fact.join(dates, "date_id").select(*REPORT_COLUMNS)
