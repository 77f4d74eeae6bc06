"""Fixed schemas of every layer."""

from pyspark.sql import types as T

TRIP_COLUMNS = [
    "id",
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

# What the CSV scan yields: every business column stays text.
TRIP_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in TRIP_COLUMNS])

_TYPED = {
    "id": T.StringType(),
    "vendor_id": T.IntegerType(),
    "pickup_datetime": T.TimestampNTZType(),
    "dropoff_datetime": T.TimestampNTZType(),
    "passenger_count": T.IntegerType(),
    "pickup_longitude": T.DoubleType(),
    "pickup_latitude": T.DoubleType(),
    "dropoff_longitude": T.DoubleType(),
    "dropoff_latitude": T.DoubleType(),
    "store_and_fwd_flag": T.StringType(),
    "trip_duration": T.IntegerType(),
}


def _typed(columns):
    return [T.StructField(c, _TYPED[c]) for c in columns]


RAW = T.StructType(
    [
        T.StructField("raw_id", T.LongType()),
        T.StructField("batch_no", T.IntegerType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]
    + TRIP_TEXT.fields
)

# One row per file of a load. Appending it is what commits the load.
LOAD_LOG = T.StructType(
    [
        T.StructField("load_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("first_batch", T.IntegerType()),
        T.StructField("last_batch", T.IntegerType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("last_raw_id", T.LongType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]
)

BATCH_LOG = T.StructType(
    [
        T.StructField("batch_no", T.IntegerType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

BATCH_RANGES = T.StructType(
    [
        T.StructField("first_batch", T.IntegerType()),
        T.StructField("last_batch", T.IntegerType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

SILVER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("batch_no", T.IntegerType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("file_hash", T.StringType()),
    ]
    + _typed(TRIP_COLUMNS[1:])
    + [
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("validation_error", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

DIM_VENDOR = T.StructType(
    [
        T.StructField("vendor_id", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

DIM_DATE = T.StructType(
    [
        T.StructField("date_id", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
    ]
)

FACT_TRIPS = T.StructType(
    _typed(["id", "vendor_id"])
    + [T.StructField("date_id", T.DateType())]
    + _typed(TRIP_COLUMNS[2:])
    + [T.StructField("updated_at", T.TimestampType())]
)
