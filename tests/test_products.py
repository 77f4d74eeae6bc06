"""Products, exports and the plans behind them."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hackney.plans.export import export_product, export_products, newest_first, register_views
from hackney.plans.pipeline import run_pipeline
from hackney.plans.products import (
    PRODUCTS,
    demand_prediction,
    eta_training,
    heatmap_grid,
    heatmap_points,
    traffic_analysis,
)
from hackney.schemas import FACT_TRIPS
from trip_files import many, write_csv

ETA = """pickup_datetime dropoff_datetime pickup_longitude pickup_latitude dropoff_longitude
dropoff_latitude passenger_count trip_duration vendor_id store_and_fwd_flag pickup_zone
dropoff_zone trip_distance_km avg_speed trips_count_1h trips_count_24h avg_trip_duration_1h
avg_trip_duration_24h congestion_level hour day_of_week is_weekend is_peak_hour""".split()
DEMAND = """pickup_datetime pickup_longitude pickup_latitude passenger_count vendor_id
store_and_fwd_flag pickup_zone trips_count_1h trips_count_24h avg_trip_duration_1h
congestion_level hour day_of_week is_weekend is_peak_hour trips_count_next_1h""".split()
TRAFFIC = """pickup_zone pickup_datetime hour day_of_week is_weekend is_peak_hour total_trips
avg_trip_duration_sec avg_trip_distance_km avg_speed_kmh max_speed_kmh min_speed_kmh
avg_passenger_count congestion_level traffic_density_score""".split()


def fact(spark, moments, durations=None, **same):
    rows = []
    for n, moment in enumerate(moments):
        duration = durations[n] if durations else 600
        row = {
            "id": f"f{n}",
            "vendor_id": 1,
            "date_id": moment.date(),
            "pickup_datetime": moment,
            "dropoff_datetime": moment + timedelta(seconds=duration),
            "passenger_count": 1 + n % 3,
            "pickup_longitude": -73.98,
            "pickup_latitude": 40.80,
            "dropoff_longitude": -73.95,
            "dropoff_latitude": 40.75,
            "store_and_fwd_flag": "N",
            "trip_duration": duration,
            "updated_at": None,
        } | same
        rows.append(tuple(row[name] for name in FACT_TRIPS.names))
    return spark.createDataFrame(rows, FACT_TRIPS)


def test_product_columns(spark):
    trips = fact(spark, [datetime(2024, 5, 1, 8)])
    assert eta_training(trips).columns == ETA
    assert demand_prediction(trips).columns == DEMAND
    assert traffic_analysis(trips).columns == TRAFFIC
    assert list(PRODUCTS) == ["eta_training", "demand_prediction", "traffic_analysis"]
    kinds = dict(eta_training(trips).dtypes)
    assert kinds["trips_count_1h"] == "bigint" and kinds["hour"] == "int"
    assert kinds["avg_trip_duration_1h"] == "double" and kinds["is_weekend"] == "boolean"


def test_levels_follow_the_hour_count(spark):
    start = datetime(2024, 5, 1, 8)
    trips = fact(spark, [start + timedelta(seconds=n) for n in range(105)])
    rows = eta_training(trips).orderBy("pickup_datetime").collect()
    assert [r.trips_count_1h for r in rows] == list(range(1, 106))
    assert [r.congestion_level for r in rows] == ["low"] * 29 + ["medium"] * 70 + ["high"] * 6
    ahead = demand_prediction(trips).orderBy("pickup_datetime").collect()
    assert [r.trips_count_next_1h for r in ahead] == list(range(104, -1, -1))


def test_traffic_figures(spark):
    moment = datetime(2024, 5, 4, 17)
    row = traffic_analysis(fact(spark, [moment] * 3, [600, 1200, 1201]), levels=(3, 2)).first()
    assert (row.total_trips, row.congestion_level, row.avg_trip_duration_sec) == (3, "high", 1000.33)
    assert (row.day_of_week, row.is_weekend, row.is_peak_hour) == (6, True, True)
    assert row.max_speed_kmh > row.avg_speed_kmh > row.min_speed_kmh
    assert row.avg_passenger_count == 2.0


def test_traffic_without_speed_has_no_density(spark):
    still = fact(spark, [datetime(2024, 5, 4, 17)], dropoff_longitude=-73.98, dropoff_latitude=40.80)
    row = traffic_analysis(still).first()
    assert row.avg_speed_kmh == 0.0 and row.traffic_density_score is None


def test_traffic_grains(spark):
    start = datetime(2024, 5, 4, 23, 59, 59)
    trips = fact(spark, [start, start + timedelta(seconds=1), start + timedelta(seconds=61)])
    counts = {
        grain: sorted(r.total_trips for r in traffic_analysis(trips, time_grain=grain).collect())
        for grain in (None, "MINUTE", "HOUR", "DAY")
    }
    assert counts == {None: [1, 1, 1], "MINUTE": [1, 1, 1], "HOUR": [1, 2], "DAY": [1, 2]}
    with pytest.raises(ValueError, match="time_grain"):
        traffic_analysis(trips, time_grain="YEAR")


def test_heat_map_hours(spark):
    moments = [datetime(2024, 5, 1, h, m, s) for h, m, s in [(5, 59, 59), (6, 0, 0), (8, 59, 59), (9, 0, 0)]]
    trips = fact(spark, moments)
    assert heatmap_points(trips).count() == 2
    assert [tuple(r) for r in heatmap_grid(trips).collect()] == [("-73.98_40.80", 2)]


def read_day(spark, result):
    return spark.read.parquet(result.path)


def test_export_limits_and_days(spark, tmp_path):
    start = datetime(2024, 5, 1)
    trips = fact(spark, [start + timedelta(minutes=n) for n in range(40)])
    product = eta_training(trips)
    first, second = date(2024, 6, 1), date(2024, 6, 2)

    def go(rows, day):
        return export_product(product, "eta_training", str(tmp_path), rows, day)

    one = go(3, first)
    assert one.rows == 3 and one.path.endswith("products/eta_training/export_date=2024-06-01")
    newest = [r.pickup_datetime for r in read_day(spark, one).collect()]
    assert newest == [start + timedelta(minutes=n) for n in (39, 38, 37)]
    assert len(list((tmp_path / "products/eta_training/export_date=2024-06-01").glob("*.parquet"))) == 1
    two = go(-1, second)
    assert two.rows == 40 and read_day(spark, two).columns == ETA
    assert read_day(spark, one).count() == 3
    assert go(5, first).rows == 5 and read_day(spark, one).count() == 5
    assert read_day(spark, two).count() == 40
    empty = go(0, first)
    assert empty.rows == 0 and read_day(spark, empty).count() == 0
    assert read_day(spark, empty).columns == ETA
    with pytest.raises(ValueError, match="max_rows"):
        go(-2, first)
    assert go(1000, first).rows == 40


def test_whole_export_is_sorted_across_files(spark, tmp_path):
    trips = spark.range(0, 20_000, 1, 8).select(
        (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(secs=F.hash("id") % 100_000))
        .cast("timestamp_ntz")
        .alias("pickup_datetime"),
        "id",
    )
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = export_product(trips, "plain", str(tmp_path), -1, date(2024, 6, 1))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = sorted((tmp_path / "products/plain/export_date=2024-06-01").glob("*.parquet"))
    assert result.rows == 20_000 and len(files) > 1
    times = [r.pickup_datetime for f in files for r in spark.read.parquet(str(f)).collect()]
    assert times == sorted(times, reverse=True)


def test_null_times_lead_and_ties_are_cut_the_same_way(spark):
    moment = datetime(2024, 5, 1)
    rows = spark.createDataFrame(
        [(moment, n) for n in range(50)] + [(None, 99)], "pickup_datetime timestamp_ntz, n int"
    ).repartition(5)
    assert [r.n for r in newest_first(rows, 4).collect()] == [99, 0, 1, 2]


def test_pipeline_to_products_and_views(spark, tmp_path):
    write_csv(tmp_path / "in/a.csv", many(30))
    wh = str(tmp_path / "wh")
    run_pipeline(spark, str(tmp_path / "in"), wh, buckets=2)
    results = export_products(spark, wh, str(tmp_path / "out"), 10, date(2024, 6, 1), buckets=2)
    assert {r.product: r.rows for r in results} == dict.fromkeys(PRODUCTS, 10)
    register_views(spark, wh, buckets=2)
    assert spark.sql("SELECT max(trips_count_1h) FROM eta_training").first()[0] == 30
    assert spark.sql("SELECT count(*) FROM v_trip_report WHERE day = 14").first()[0] == 30


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    trips = fact(spark, [datetime(2024, 5, 1, 8)])
    limited = plan_of(newest_first(eta_training(trips), 10))
    assert "TakeOrderedAndProject" in limited
    for name, product in PRODUCTS.items():
        plan = plan_of(product(trips))
        assert "Python" not in plan and "CartesianProduct" not in plan, name
        assert "NestedLoop" not in plan, name
    # All counts and averages share one running window.
    assert plan_of(eta_training(trips)).count("Window [") == 2
    grouped = plan_of(traffic_analysis(trips))
    assert grouped.count("Exchange") == 1 and "partial_avg" in grouped


def test_scans_read_only_the_columns_they_need(spark, tmp_path):
    path = str(tmp_path / "fact")
    fact(spark, [datetime(2024, 5, 1, 8)]).write.parquet(path)
    stored = spark.read.schema(FACT_TRIPS).parquet(path)
    plan = plan_of(heatmap_grid(stored))
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "trip_duration" not in schema and "pickup_latitude" in schema
    assert "updated_at" not in plan_of(eta_training(stored))


@pytest.mark.parametrize("limit", [11, 37, 150, 500])
def test_a_large_limited_export_has_exactly_the_first_rows(spark, tmp_path, monkeypatch, limit):
    from hackney.plans import export

    monkeypatch.setattr(export, "ONE_TASK_ROWS", 10)
    start = datetime(2024, 5, 1)
    trips = fact(spark, [start + timedelta(minutes=n // 5) for n in range(200)])
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = export_product(trips, "plain", str(tmp_path), limit, date(2024, 6, 1))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = newest_first(trips, limit).collect()
    day = tmp_path / "products/plain/export_date=2024-06-01"
    files = sorted(day.glob("*.parquet"))
    got = [r for f in files for r in spark.read.parquet(str(f)).select(*trips.columns).collect()]
    assert result.rows == len(want) and got == want
    assert limit < 100 or len(files) > 1
    assert not (tmp_path / "products/_stage/plain").exists()
