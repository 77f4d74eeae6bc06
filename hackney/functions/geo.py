"""Grid zones, great-circle distance and speed as Catalyst expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the products are defined with.
EARTH_RADIUS_KM = 6371
ZONE_DECIMALS = 2
SECONDS_PER_HOUR = 3600.0


def _grid_text(degrees: Column) -> Column:
    """Degrees rounded half up to two decimals, trailing zeros kept.

    Rounding runs on decimals because a rounded double prints ``40.8``, not
    ``40.80``. A coordinate has no range check upstream, so one too large for
    the narrow decimal takes a wide one, and NaN or infinity its own text.
    """
    narrow = F.round(degrees.try_cast("decimal(18,13)"), ZONE_DECIMALS).cast("string")
    wide = F.round(degrees.try_cast("decimal(38,13)"), ZONE_DECIMALS).cast("string")
    return F.when(F.abs(degrees) < 99999.0, narrow).otherwise(
        F.coalesce(wide, degrees.cast("string"))
    )


def zone_key(longitude: Column, latitude: Column) -> Column:
    """``<lon>_<lat>`` grid cell; NULL when either coordinate is NULL."""
    return F.concat(_grid_text(longitude), F.lit("_"), _grid_text(latitude))


def haversine_km(
    from_latitude: Column,
    from_longitude: Column,
    to_latitude: Column,
    to_longitude: Column,
) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians((to_latitude - from_latitude) / 2.0))
    half_lon = F.sin(F.radians((to_longitude - from_longitude) / 2.0))
    chord = F.pow(half_lat, F.lit(2.0)) + F.cos(F.radians(from_latitude)) * F.cos(
        F.radians(to_latitude)
    ) * F.pow(half_lon, F.lit(2.0))
    # Antipodes can land a hair above 1; NaN must stay NaN and sorts above 1.
    chord = F.when((chord > 1.0) & ~F.isnan(chord), F.lit(1.0)).otherwise(chord)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def speed_kmh(distance_km: Column, duration_seconds: Column) -> Column:
    """Kilometres per hour; NULL unless the duration is positive."""
    return F.when(
        duration_seconds > 0,
        distance_km / (duration_seconds / F.lit(SECONDS_PER_HOUR)),
    )
