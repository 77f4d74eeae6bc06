"""The driver's tables in trip shape.

No trip table is given, so trips are derived from ``events`` row by row with
fixed formulae; nothing is dropped or sampled.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(value: float) -> Column:
    return F.lit(value).cast("double")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as typed trips."""
    events = table(spark, sf_dir, "events")
    event, user = F.col("event_id"), F.col("user_id")
    pickup = F.col("ts").cast("timestamp_ntz")
    duration = (1 + F.floor(F.col("value") * 10)).cast("int")
    return events.select(
        event.cast("string").alias("id"),
        (1 + event % 2).cast("int").alias("vendor_id"),
        pickup.alias("pickup_datetime"),
        (pickup + F.make_dt_interval(secs=duration)).alias("dropoff_datetime"),
        (1 + user % 6).cast("int").alias("passenger_count"),
        (_number(-74.0) + (user % 7) * _number(0.011)).alias("pickup_longitude"),
        (_number(40.7) + (user % 5) * _number(0.013)).alias("pickup_latitude"),
        (_number(-73.95) - (event % 11) * _number(0.007)).alias("dropoff_longitude"),
        (_number(40.75) + (event % 13) * _number(0.003)).alias("dropoff_latitude"),
        F.when(event % 3 == 0, "Y").otherwise("N").alias("store_and_fwd_flag"),
        duration.alias("trip_duration"),
    )


def trip_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trips as raw text plus ``event_id``, with every kind of defect.

    A quarter of the rows carry the id of a row two batches before them, so that
    valid and invalid rows replace each other.
    """
    typed = trips(spark, sf_dir).withColumn("_n", F.col("id").cast("bigint"))
    n = F.col("_n")

    def text(name: str, *defects: tuple[int, int, str | None]) -> Column:
        value = F.col(name).cast("string")
        if not defects:
            return value.alias(name)
        chain = None
        for modulus, rest, replacement in defects:
            bad = F.lit(replacement).cast("string")
            hit = n % modulus == rest
            chain = F.when(hit, bad) if chain is None else chain.when(hit, bad)
        return chain.otherwise(value).alias(name)

    again = (n % 4 == 1) & (n >= 1999)
    own_id = F.when(again, n - 1999).otherwise(n).cast("string")
    return typed.select(
        n.alias("event_id"),
        F.when(n % 101 == 1, F.lit("  "))
        .when(n % 103 == 2, F.lit(None).cast("string"))
        .when(n % 5 == 0, F.concat(F.lit(" "), own_id, F.lit(" ")))
        .otherwise(own_id)
        .alias("id"),
        text("vendor_id", (47, 3, "x"), (53, 4, "1.0"), (59, 5, " 2 ")),
        text("pickup_datetime", (61, 6, "14/03/2016"), (67, 7, None)),
        text("dropoff_datetime", (71, 8, "bad"), (73, 9, "2016-03-14 17:00:00")),
        text("passenger_count", (79, 10, "0"), (83, 11, "-1"), (89, 12, None)),
        text("pickup_longitude", (97, 13, None)),
        text("pickup_latitude", (41, 14, "abc")),
        text("dropoff_longitude", (43, 15, "")),
        text("dropoff_latitude", (107, 16, "north")),
        F.when(n % 31 == 17, F.lit("Z"))
        .when(n % 37 == 18, F.lit(None).cast("string"))
        .when(n % 29 == 19, F.lit(" n "))
        .when(n % 109 == 20, F.lit(""))
        .otherwise(F.col("store_and_fwd_flag"))
        .alias("store_and_fwd_flag"),
        text("trip_duration", (113, 21, "0"), (127, 22, "1e3"), (131, 23, None)),
    )
