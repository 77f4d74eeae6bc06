import math

from pyspark.sql import functions as F

from hackney.functions import (
    calendar_columns,
    congestion_level,
    haversine_km,
    speed_kmh,
    zone_key,
)


def zones(spark, pairs):
    rows = spark.createDataFrame(
        [(n, *pair) for n, pair in enumerate(pairs)], "n int, lon double, lat double"
    )
    zoned = rows.select("n", zone_key(F.col("lon"), F.col("lat")).alias("zone"))
    return [r.zone for r in zoned.orderBy("n").collect()]


def test_zone_keeps_trailing_zeros_and_rounds_half_away_from_zero(spark):
    assert zones(
        spark,
        [
            (-73.982154846191406, 40.767936706542969),
            (-74.0, 40.8),
            (-73.945, 40.755),
            (-73.9449999, 40.7549999),
            (-0.001, 0.0),
            (0.005, -0.005),
        ],
    ) == [
        "-73.98_40.77",
        "-74.00_40.80",
        "-73.95_40.76",
        "-73.94_40.75",
        "0.00_0.00",
        "0.01_-0.01",
    ]


def test_zone_of_coordinates_out_of_any_range(spark):
    assert zones(
        spark,
        [
            (None, 40.0),
            (float("nan"), 1.0),
            (float("inf"), 1.0),
            (123456.789, 1e20),
        ],
    ) == [None, "NaN_1.00", "Infinity_1.00", "123456.79_100000000000000000000.00"]


def great_circle(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    x = math.sin((b - a) / 2) ** 2
    x += math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(x)))


def test_haversine(spark):
    points = [
        (40.767936706542969, -73.982154846191406, 40.765602111816406, -73.964630126953125),
        (0.0, 0.0, 0.0, 180.0),
        (90.0, 0.0, -90.0, 0.0),
        (12.3, 45.6, 12.3, 45.6),
        (1.0, 179.0, -1.0, -1.0),
    ]
    rows = spark.createDataFrame(
        [(n, *p) for n, p in enumerate(points)], "n int, a double, b double, c double, d double"
    )
    km = haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    got = [r.km for r in rows.select("n", km.alias("km")).orderBy("n").collect()]
    for value, point in zip(got, points):
        assert math.isclose(value, great_circle(*point), rel_tol=1e-12, abs_tol=1e-9)
    assert round(got[0], 6) == 1.498521


def test_haversine_of_nan_is_nan_and_of_null_is_null(spark):
    row = spark.range(1).select(
        haversine_km(F.lit(float("nan")), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("nan"),
        haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("null"),
    ).first()
    assert math.isnan(row.nan) and row.null is None


def test_speed_needs_a_positive_duration(spark):
    rows = spark.createDataFrame([(1, 3600), (2, 0), (3, -5), (4, None)], "n int, s int")
    got = rows.select("n", speed_kmh(F.lit(10.0), F.col("s")).alias("v")).orderBy("n")
    assert [r.v for r in got.collect()] == [10.0, None, None, None]


def test_calendar(spark):
    texts = [
        "2024-01-07 00:00:00",  # a Sunday
        "2024-01-08 07:59:59",
        "2024-01-12 10:00:00",
        "2024-01-13 18:00:00",  # a Saturday
        "2024-01-09 19:00:00",
    ]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    moment = F.col("t").cast("timestamp_ntz")
    got = rows.select("n", *calendar_columns(moment)).orderBy("n").collect()
    assert [tuple(r)[1:] for r in got] == [
        (0, 0, True, False),
        (7, 1, False, True),
        (10, 5, False, False),
        (18, 6, True, True),
        (19, 2, False, False),
    ]


def test_calendar_ignores_the_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist in New York on this day.
        row = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00' AS t")
        assert row.select(*calendar_columns(F.col("t"))).first() == (2, 0, True, False)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_levels(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 29, 30, 99, 100)], "n int")
    got = rows.select("n", congestion_level(F.col("n")).alias("l")).orderBy("n")
    assert [r.l for r in got.collect()] == ["low", "low", "medium", "medium", "high"]
