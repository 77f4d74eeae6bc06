"""Selecting the newest rows without sorting the rest.

A histogram over the span of all times tells in which bin the n-th newest row lies; the
next one spans that bin alone, and so on. Each pass is one aggregate of at most ``BINS``
groups, so the driver sees counts only.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
# The last bin may hold this share of the wanted rows; below it, no pass refines it further.
NARROW = 1 / 8


@dataclass(frozen=True)
class Span:
    """Seconds ``low`` to before ``high``: ``above`` rows are newer, ``inside`` lie in it.

    Without ends it is the rows without a time, which come before all others.
    """

    low: int | None
    high: int | None
    above: int
    inside: int


def seconds_of(rows: DataFrame, column: str) -> Column:
    """The whole second of a time, on a scale that no session setting bends."""
    at = F.col(column)
    if rows.schema[column].dataType.typeName() == "timestamp":
        return F.unix_seconds(at)
    day = F.unix_date(F.to_date(at)).cast("bigint") * 86400
    return day + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def newest_span(rows: DataFrame, column: str, n: int, bins: int = BINS) -> Span | None:
    """The span of time with the ``n``-th newest row, times that are NULL leading.

    None if there are no more than ``n`` rows.
    """
    times = rows.select(seconds_of(rows, column).alias("at"))
    found = times.agg(
        F.min("at").alias("low"),
        F.max("at").alias("high"),
        F.count("at").alias("dated"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    if found.rows <= n:
        return None
    above = found.rows - found.dated
    if above >= n:
        return Span(None, None, 0, above)
    low, high, inside = found.low, found.high + 1, found.dated
    while high - low > 1 and inside > n * NARROW:
        width = -((low - high) // bins)
        counts = (
            times.where(F.col("at").between(low, high - 1))
            .groupBy(F.floor((F.col("at") - low) / F.lit(float(width))).alias("bin"))
            .count()
            .collect()
        )
        for row in sorted(counts, reverse=True):
            inside = row["count"]
            if above + inside >= n:
                low, high = low + row.bin * width, min(high, low + (row.bin + 1) * width)
                break
            above += inside
    return Span(low, high, above, inside)
