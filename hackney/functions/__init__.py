from hackney.functions.calendar import (
    calendar_columns,
    day_of_week,
    is_peak_hour,
    is_weekend,
)
from hackney.functions.geo import haversine_km, speed_kmh, zone_key
from hackney.functions.levels import congestion_level

__all__ = [
    "calendar_columns",
    "congestion_level",
    "day_of_week",
    "haversine_km",
    "is_peak_hour",
    "is_weekend",
    "speed_kmh",
    "zone_key",
]
