"""The library's operators as queries over the driver's tables.

Each query reads its tables whole. Floating-point results are rounded to six
places, so that engines which add in another order agree.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hackney.adapters import table, trip_texts, trips
from hackney.functions import (
    calendar_columns,
    congestion_level,
    haversine_km,
    speed_kmh,
)
from hackney.operators import (
    assign_batches,
    clean,
    distinct_batches,
    first_delivery,
    latest_by_key,
    max_batch_no,
    merge_by_key,
    new_files,
    pending_batches,
    rule_counts,
    validate,
)
from hackney.operators.validation import COUNTS
from hackney.plans import export, gold, products
from hackney.plans.silver import latest_valid, silver_rows
from hackney.schemas import TRIP_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def query_named(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def dates_as_text(frame: DataFrame) -> DataFrame:
    """Clients also differ in the type of a date; its text is the same."""
    return frame.withColumn("date_id", F.col("date_id").cast("string"))


def rounded(frame: DataFrame) -> DataFrame:
    doubles = {
        name: F.round(name, 6) for name, kind in frame.dtypes if kind == "double"
    }
    return frame.withColumns(doubles) if doubles else frame


# Feature products ----------------------------------------------------------


@query
def eta_training(spark, sf_dir):
    return rounded(products.eta_training(trips(spark, sf_dir)))


@query
def demand_prediction(spark, sf_dir):
    return rounded(products.demand_prediction(trips(spark, sf_dir)))


@query
def traffic_analysis(spark, sf_dir):
    return products.traffic_analysis(trips(spark, sf_dir))


@query
def traffic_analysis_daily(spark, sf_dir):
    return products.traffic_analysis(
        trips(spark, sf_dir), levels=(20, 10), time_grain="DAY"
    )


@query
def heatmap_points(spark, sf_dir):
    return rounded(products.heatmap_points(trips(spark, sf_dir)))


@query
def heatmap_grid(spark, sf_dir):
    return products.heatmap_grid(trips(spark, sf_dir))


# Scalar features -----------------------------------------------------------


@query_named("zone_key")
def zone_keys(spark, sf_dir):
    zoned = products.with_zone(trips(spark, sf_dir), "pickup")
    return products.with_zone(zoned, "dropoff").select(
        "id", "pickup_zone", "dropoff_zone"
    )


def _distance():
    return haversine_km(
        F.col("pickup_latitude"),
        F.col("pickup_longitude"),
        F.col("dropoff_latitude"),
        F.col("dropoff_longitude"),
    )


@query_named("haversine_km")
def trip_distance(spark, sf_dir):
    return rounded(
        trips(spark, sf_dir).select("id", _distance().alias("trip_distance_km"))
    )


@query
def avg_speed(spark, sf_dir):
    speed = speed_kmh(_distance(), F.col("trip_duration"))
    return rounded(trips(spark, sf_dir).select("id", speed.alias("avg_speed")))


@query
def calendar_features(spark, sf_dir):
    return trips(spark, sf_dir).select("id", *calendar_columns(F.col("pickup_datetime")))


# Rolling statistics --------------------------------------------------------


def _rolled(spark, sf_dir, *frames):
    return products.with_rolling(
        products.with_zone(trips(spark, sf_dir), "pickup"), *frames
    )


@query
def rolling_1h(spark, sf_dir):
    return rounded(
        _rolled(spark, sf_dir, products.LAST_HOUR).select(
            "id", "pickup_zone", "trips_count_1h", "avg_trip_duration_1h"
        )
    )


@query
def rolling_24h(spark, sf_dir):
    return rounded(
        _rolled(spark, sf_dir, products.LAST_DAY).select(
            "id", "pickup_zone", "trips_count_24h", "avg_trip_duration_24h"
        )
    )


@query
def lookahead_next_1h(spark, sf_dir):
    return _rolled(spark, sf_dir, products.NEXT_HOUR).select(
        "id",
        "pickup_zone",
        (F.col("trips_count_next_1h") - 1).alias("trips_count_next_1h"),
    )


@query_named("congestion_level")
def congestion_levels(spark, sf_dir):
    """Lower thresholds than the product's, so that every level occurs."""
    level = congestion_level(F.col("trips_count_1h"), (3, 2))
    return _rolled(spark, sf_dir, products.LAST_HOUR).select(
        "id", "trips_count_1h", level.alias("congestion_level")
    )


# Silver --------------------------------------------------------------------


def _raw(spark, sf_dir):
    """Dirty trip texts as rows of the raw layer: a thousand events a batch."""
    event = F.col("event_id")
    texts = trip_texts(spark, sf_dir)
    return texts.select(
        (event + 1).alias("raw_id"),
        (F.floor(event / 1000) + 1).cast("int").alias("batch_no"),
        F.lit("events").alias("source_file"),
        F.sha2(F.lit("events"), 256).alias("file_hash"),
        *TRIP_COLUMNS,
    )


def _silver(spark, sf_dir):
    return latest_valid(silver_rows(_raw(spark, sf_dir)))


@query
def silver_clean(spark, sf_dir):
    typed = clean(_raw(spark, sf_dir)).select("raw_id", *TRIP_COLUMNS)
    # Whole numbers with gaps compare as doubles: clients differ in how they
    # show a missing integer.
    return rounded(typed.withColumns({c: F.col(c).cast("double") for c in COUNTS}))


@query
def silver_validate(spark, sf_dir):
    return validate(clean(_raw(spark, sf_dir))).select(
        "raw_id", "id", "validation_error", "is_valid"
    )


@query
def silver_rejects(spark, sf_dir):
    judged = silver_rows(_raw(spark, sf_dir))
    return judged.where("NOT is_valid").select("raw_id", "batch_no", "validation_error")


@query
def invalid_rule_counts(spark, sf_dir):
    return rule_counts(clean(_raw(spark, sf_dir)))


@query
def silver_build(spark, sf_dir):
    return rounded(_silver(spark, sf_dir).drop("updated_at"))


LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]
LINE_COLUMNS = [*LINE_KEY, *LINE_ORDER, "l_quantity"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query
def silver_last_write_wins(spark, sf_dir):
    lines = _lines(spark, sf_dir).select(*LINE_COLUMNS)
    return rounded(latest_by_key(lines, LINE_KEY, LINE_ORDER))


def _line_merge(spark, sf_dir, keep):
    """Finished lines as stored rows, open lines as the incoming ones."""
    lines = _lines(spark, sf_dir)
    stored, incoming = (
        latest_by_key(
            lines.where(F.col("l_linestatus") == status).select(
                *LINE_COLUMNS, "l_linestatus"
            ),
            LINE_KEY,
            LINE_ORDER,
        )
        for status in ("F", "O")
    )
    return rounded(merge_by_key(stored, incoming, LINE_KEY, keep))


@query
def upsert_silver(spark, sf_dir):
    return _line_merge(spark, sf_dir, "incoming")


@query
def upsert_keep_stored(spark, sf_dir):
    return _line_merge(spark, sf_dir, "stored")


# Gold ----------------------------------------------------------------------


@query
def dim_vendor(spark, sf_dir):
    return gold.dim_vendor_rows(_silver(spark, sf_dir)).select("vendor_id")


@query
def dim_date(spark, sf_dir):
    return dates_as_text(gold.dim_date_rows(_silver(spark, sf_dir)))


@query
def dim_date_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.lit(True).alias("is_valid"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("pickup_datetime"),
    )
    return dates_as_text(gold.dim_date_rows(orders))


@query
def fact_trips(spark, sf_dir):
    facts = gold.fact_rows(_silver(spark, sf_dir)).drop("updated_at")
    return dates_as_text(rounded(facts))


@query
def v_trip_report(spark, sf_dir):
    silver = _silver(spark, sf_dir)
    report = gold.v_trip_report(gold.fact_rows(silver), gold.dim_date_rows(silver))
    return rounded(report)


@query
def upsert_fact(spark, sf_dir):
    """All trips stored; a correction arrives under twice the id of every trip."""
    stored = trips(spark, sf_dir)
    incoming = stored.withColumns(
        {
            "id": (F.col("id").cast("bigint") * 2).cast("string"),
            "trip_duration": F.col("trip_duration") + 60,
        }
    )
    merged = merge_by_key(stored, incoming, ["id"])
    return merged.select("id", "vendor_id", "pickup_datetime", "trip_duration")


# Ingestion state -----------------------------------------------------------


def _batches(spark, sf_dir, name, key):
    """A table's rows as raw rows, a thousand key values to a batch."""
    number = (F.floor(F.col(key) / 1000) + 1).cast("int")
    return table(spark, sf_dir, name).withColumn("batch_no", number)


@query_named("distinct_batches")
def distinct_batch_numbers(spark, sf_dir):
    return distinct_batches(_batches(spark, sf_dir, "orders", "o_orderkey"))


@query_named("max_batch_no")
def highest_batch(spark, sf_dir):
    return max_batch_no(_batches(spark, sf_dir, "orders", "o_orderkey"))


def _pending(spark, sf_dir):
    """Batches of orders that the events, as the ledger, do not cover."""
    return pending_batches(
        distinct_batches(_batches(spark, sf_dir, "orders", "o_orderkey")),
        distinct_batches(_batches(spark, sf_dir, "events", "event_id")),
    )


@query_named("pending_batches")
def pending_batch_numbers(spark, sf_dir):
    return _pending(spark, sf_dir).orderBy("batch_no")


@query
def batch_scan(spark, sf_dir):
    rows = _batches(spark, sf_dir, "orders", "o_orderkey")
    return rounded(
        rows.select("batch_no", "o_orderkey", "o_custkey", "o_totalprice").join(
            _pending(spark, sf_dir), "batch_no", "left_semi"
        )
    )


@query
def batch_equality(spark, sf_dir):
    """The rows of one batch, the last one pending, by equality."""
    rows = _batches(spark, sf_dir, "orders", "o_orderkey")
    last = _pending(spark, sf_dir).agg(F.max("batch_no")).first()[0]
    return rounded(
        rows.where(F.col("batch_no") == F.lit(last)).select(
            "batch_no", "o_orderkey", "o_custkey", "o_totalprice"
        )
    )


@query
def batch_assignment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return assign_batches(orders, "o_orderkey", chunk_size=700, after=41)


def _document_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file_name"),
        F.sha2("text", 256).alias("file_hash"),
    )


@query
def sha256_fingerprint(spark, sf_dir):
    return _document_files(spark, sf_dir).select("doc_id", "file_hash")


@query
def incremental_new_files(spark, sf_dir):
    """Documents as files; those with a label are in the ledger."""
    files = _document_files(spark, sf_dir)
    ledger = files.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return new_files(files, ledger).select("doc_id", "file_name", "file_hash")


@query
def first_deliveries(spark, sf_dir):
    """Equal texts of one source are one delivery, its lowest document first."""
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("file_name"),
        F.sha2("text", 256).alias("file_hash"),
    )
    return first_delivery(files, order="doc_id")


# Exports -------------------------------------------------------------------


@query
def export_latest_n(spark, sf_dir):
    return rounded(export.newest_first(products.eta_training(trips(spark, sf_dir))))


@query
def export_all_sorted(spark, sf_dir):
    demand = products.demand_prediction(trips(spark, sf_dir))
    return rounded(export.newest_first(demand, export.ALL_ROWS))
