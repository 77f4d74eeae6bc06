"""Safe casts of raw text and the nine row rules."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COORDINATES = (
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
)
COUNTS = ("vendor_id", "passenger_count", "trip_duration")
MOMENTS = ("pickup_datetime", "dropoff_datetime")


def clean(rows: DataFrame) -> DataFrame:
    """Raw text cast to the silver types; what cannot be cast becomes NULL."""
    typed = {"id": F.trim(F.col("id").cast("string"))}
    typed |= {c: F.col(c).try_cast("int") for c in COUNTS}
    # Zone-less on purpose: no session time zone, no "today" for a bare time.
    typed |= {c: F.col(c).try_cast("timestamp_ntz") for c in MOMENTS}
    typed |= {c: F.col(c).try_cast("double") for c in COORDINATES}
    flag = F.col("store_and_fwd_flag").cast("string")
    typed["store_and_fwd_flag"] = F.upper(F.trim(flag))
    return rows.withColumns(typed)


def _missing(name: str) -> Column:
    return F.col(name).isNull()


def _not_positive(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) <= 0)


def _any_missing(names) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | F.col(name).isNull()
    return found


# Rule texts and their order are part of the stored result.
# A NULL flag and a NULL on either side of the time rule stay silent.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("missing id", lambda: F.col("id").isNull() | (F.col("id") == "")),
    ("bad vendor_id", lambda: _missing("vendor_id")),
    ("bad pickup_datetime", lambda: _missing("pickup_datetime")),
    ("bad dropoff_datetime", lambda: _missing("dropoff_datetime")),
    (
        "dropoff before pickup",
        lambda: F.col("dropoff_datetime") < F.col("pickup_datetime"),
    ),
    ("bad passenger_count", lambda: _not_positive("passenger_count")),
    ("bad coordinates", lambda: _any_missing(COORDINATES)),
    (
        "bad store_and_fwd_flag",
        lambda: ~F.col("store_and_fwd_flag").isin("Y", "N"),
    ),
    ("bad trip_duration", lambda: _not_positive("trip_duration")),
]


def validate(typed: DataFrame) -> DataFrame:
    """Adds ``validation_error`` (every broken rule, in order) and ``is_valid``."""
    error = F.concat(
        *[F.when(broken(), f"{text}; ").otherwise("") for text, broken in RULES]
    )
    return typed.withColumn("validation_error", error).withColumn(
        "is_valid", F.col("validation_error") == ""
    )


def rule_counts(typed: DataFrame) -> DataFrame:
    """Rows that break each rule, in one pass; every rule is listed."""
    counted = typed.agg(
        *[F.count_if(broken()).alias(text) for text, broken in RULES]
    )
    return counted.unpivot([], [text for text, _ in RULES], "rule", "rows")
