"""Three-step congestion levels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the products are defined with: (high from, medium from).
ROLLING_LEVELS = (100, 30)
GROUPED_LEVELS = (500, 200)


def congestion_level(count: Column, levels: tuple[int, int] = ROLLING_LEVELS) -> Column:
    high, medium = levels
    return (
        F.when(count >= high, F.lit("high"))
        .when(count >= medium, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
