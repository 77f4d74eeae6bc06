"""The report and the three feature products, as functions of the star schema."""

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hackney.functions import (
    calendar_columns,
    congestion_level,
    haversine_km,
    speed_kmh,
    zone_key,
)
from hackney.functions.levels import GROUPED_LEVELS, ROLLING_LEVELS
from hackney.operators.rolling import Frame, rolling_statistics

HOUR = timedelta(hours=1)
DAY = timedelta(hours=24)

LAST_HOUR = Frame("trips_count_1h", back=HOUR, average="avg_trip_duration_1h")
LAST_DAY = Frame("trips_count_24h", back=DAY, average="avg_trip_duration_24h")
LAST_DAY_COUNT = Frame("trips_count_24h", back=DAY)
NEXT_HOUR = Frame("trips_count_next_1h", ahead=HOUR)

MORNING_HOURS = (6, 9)


def with_zone(trips: DataFrame, side: str) -> DataFrame:
    """Adds ``<side>_zone`` for the side "pickup" or "dropoff"."""
    zone = zone_key(F.col(f"{side}_longitude"), F.col(f"{side}_latitude"))
    return trips.withColumn(f"{side}_zone", zone)


def with_distance(trips: DataFrame) -> DataFrame:
    """Adds ``trip_distance_km`` and ``avg_speed``."""
    return trips.withColumn(
        "trip_distance_km",
        haversine_km(
            F.col("pickup_latitude"),
            F.col("pickup_longitude"),
            F.col("dropoff_latitude"),
            F.col("dropoff_longitude"),
        ),
    ).withColumn(
        "avg_speed", speed_kmh(F.col("trip_distance_km"), F.col("trip_duration"))
    )


def with_rolling(trips: DataFrame, *frames: Frame) -> DataFrame:
    """Rolling statistics per pickup zone over pickup time."""
    return rolling_statistics(
        trips, "pickup_zone", "pickup_datetime", frames, value="trip_duration"
    )


def eta_training(
    fact: DataFrame, levels: tuple[int, int] = ROLLING_LEVELS
) -> DataFrame:
    """One row per trip with the features an arrival-time model trains on."""
    rolled = with_rolling(with_zone(fact, "pickup"), LAST_HOUR, LAST_DAY)
    # Distance and dropoff zone follow from the row, so they are computed after
    # the shuffle that fetches the rolling statistics, not carried through it.
    return with_distance(with_zone(rolled, "dropoff")).select(
        "pickup_datetime",
        "dropoff_datetime",
        "pickup_longitude",
        "pickup_latitude",
        "dropoff_longitude",
        "dropoff_latitude",
        "passenger_count",
        "trip_duration",
        "vendor_id",
        "store_and_fwd_flag",
        "pickup_zone",
        "dropoff_zone",
        "trip_distance_km",
        "avg_speed",
        "trips_count_1h",
        "trips_count_24h",
        "avg_trip_duration_1h",
        "avg_trip_duration_24h",
        congestion_level(F.col("trips_count_1h"), levels).alias("congestion_level"),
        *calendar_columns(F.col("pickup_datetime")),
    )


def demand_prediction(
    fact: DataFrame, levels: tuple[int, int] = ROLLING_LEVELS
) -> DataFrame:
    """One row per trip with recent demand and the next hour's demand as label."""
    zoned = with_zone(fact, "pickup")
    rolled = with_rolling(zoned, LAST_HOUR, LAST_DAY_COUNT, NEXT_HOUR)
    return rolled.select(
        "pickup_datetime",
        "pickup_longitude",
        "pickup_latitude",
        "passenger_count",
        "vendor_id",
        "store_and_fwd_flag",
        "pickup_zone",
        "trips_count_1h",
        "trips_count_24h",
        "avg_trip_duration_1h",
        congestion_level(F.col("trips_count_1h"), levels).alias("congestion_level"),
        *calendar_columns(F.col("pickup_datetime")),
        # The frame holds the trip itself; other trips of its instant do count.
        (F.col("trips_count_next_1h") - 1).alias("trips_count_next_1h"),
    )


def _truncated(ts: Column, grain: str | None) -> Column:
    # date_trunc would take a zone-less time through the session time zone.
    midnight = F.to_date(ts).cast("timestamp_ntz")
    if grain is None:
        return ts
    if grain == "DAY":
        return midnight
    if grain == "HOUR":
        return midnight + F.make_dt_interval(hours=F.hour(ts))
    if grain == "MINUTE":
        return midnight + F.make_dt_interval(hours=F.hour(ts), mins=F.minute(ts))
    raise ValueError(f"time_grain must be MINUTE, HOUR or DAY, not {grain!r}")


def traffic_analysis(
    fact: DataFrame,
    levels: tuple[int, int] = GROUPED_LEVELS,
    time_grain: str | None = None,
) -> DataFrame:
    """Traffic figures per zone and pickup instant.

    ``time_grain`` ("MINUTE", "HOUR" or "DAY") truncates the instant first; the
    default keeps it as it is.
    """
    moment = _truncated(F.col("pickup_datetime"), time_grain)
    measured = with_distance(with_zone(fact, "pickup")).select(
        "pickup_zone",
        moment.alias("pickup_datetime"),
        "trip_duration",
        "trip_distance_km",
        "avg_speed",
        "passenger_count",
    )
    # The calendar columns follow from the instant, so they are no group keys.
    grouped = measured.groupBy("pickup_zone", "pickup_datetime").agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.avg("trip_duration").alias("duration"),
        F.avg("trip_distance_km").alias("distance"),
        F.avg("avg_speed").alias("speed"),
        F.max("avg_speed").alias("fastest"),
        F.min("avg_speed").alias("slowest"),
        F.avg("passenger_count").alias("passengers"),
    )
    density = F.col("total_trips") / F.nullif(F.col("speed"), F.lit(0.0))
    return grouped.select(
        "pickup_zone",
        "pickup_datetime",
        *calendar_columns(F.col("pickup_datetime")),
        "total_trips",
        F.round("duration", 2).alias("avg_trip_duration_sec"),
        F.round("distance", 2).alias("avg_trip_distance_km"),
        F.round("speed", 2).alias("avg_speed_kmh"),
        F.round("fastest", 2).alias("max_speed_kmh"),
        F.round("slowest", 2).alias("min_speed_kmh"),
        F.round("passengers", 2).alias("avg_passenger_count"),
        congestion_level(F.col("total_trips"), levels).alias("congestion_level"),
        F.round(density, 2).alias("traffic_density_score"),
    )


def _between_hours(trips: DataFrame, hours: tuple[int, int]) -> DataFrame:
    start, end = hours
    hour = F.hour("pickup_datetime")
    return trips.where((hour >= start) & (hour < end))


def heatmap_points(
    trips: DataFrame, hours: tuple[int, int] = MORNING_HOURS
) -> DataFrame:
    """Pickup points of trips that start within ``hours`` (end excluded)."""
    return _between_hours(trips, hours).select(
        F.col("pickup_latitude").alias("latitude"),
        F.col("pickup_longitude").alias("longitude"),
    )


def heatmap_grid(trips: DataFrame, hours: tuple[int, int] = MORNING_HOURS) -> DataFrame:
    """The same points counted per grid zone."""
    return (
        with_zone(_between_hours(trips, hours), "pickup")
        .groupBy("pickup_zone")
        .agg(F.count(F.lit(1)).alias("trips"))
    )


# Exported products by name; each is a function of gold.fact_trips.
PRODUCTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "eta_training": eta_training,
    "demand_prediction": demand_prediction,
    "traffic_analysis": traffic_analysis,
}
