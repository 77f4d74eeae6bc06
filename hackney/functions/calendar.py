"""Calendar features of a zone-less timestamp."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the products are defined with.
WEEKEND_DAYS = (0, 6)
PEAK_HOURS = (7, 8, 9, 16, 17, 18)


def day_of_week(ts: Column) -> Column:
    """0 is Sunday, 6 is Saturday."""
    return F.dayofweek(ts) - 1


def is_weekend(ts: Column) -> Column:
    return day_of_week(ts).isin(*WEEKEND_DAYS)


def is_peak_hour(ts: Column) -> Column:
    return F.hour(ts).isin(*PEAK_HOURS)


def calendar_columns(ts: Column) -> list[Column]:
    """hour, day_of_week, is_weekend, is_peak_hour, in product order."""
    return [
        F.hour(ts).alias("hour"),
        day_of_week(ts).alias("day_of_week"),
        is_weekend(ts).alias("is_weekend"),
        is_peak_hour(ts).alias("is_peak_hour"),
    ]
