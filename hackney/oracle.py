"""The registered queries as plain SQL for DuckDB, written by hand.

These texts share no code with the Spark side; they state the same results over
the driver's tables with ordinary windows, joins and groups.
"""

TRIPS = """
trips AS (
    SELECT
        event_id,
        CAST(event_id AS VARCHAR) AS id,
        CAST(1 + event_id % 2 AS INTEGER) AS vendor_id,
        ts AS pickup_datetime,
        ts + to_seconds(CAST(1 + floor(value * 10) AS BIGINT)) AS dropoff_datetime,
        CAST(1 + user_id % 6 AS INTEGER) AS passenger_count,
        CAST(-74.0 AS DOUBLE) + (user_id % 7) * CAST(0.011 AS DOUBLE) AS pickup_longitude,
        CAST(40.7 AS DOUBLE) + (user_id % 5) * CAST(0.013 AS DOUBLE) AS pickup_latitude,
        CAST(-73.95 AS DOUBLE) - (event_id % 11) * CAST(0.007 AS DOUBLE) AS dropoff_longitude,
        CAST(40.75 AS DOUBLE) + (event_id % 13) * CAST(0.003 AS DOUBLE) AS dropoff_latitude,
        CASE WHEN event_id % 3 = 0 THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
        CAST(1 + floor(value * 10) AS INTEGER) AS trip_duration
    FROM events
)"""


def _zone(side: str) -> str:
    def grid(axis: str) -> str:
        column = f"{side}_{axis}"
        return f"CAST(CAST(round(CAST({column} AS DECIMAL(18,13)), 2) AS DECIMAL(18,2)) AS VARCHAR)"

    return f"{grid('longitude')} || '_' || {grid('latitude')}"


KM = """
        12742.0 * asin(sqrt(
            pow(sin(radians((dropoff_latitude - pickup_latitude) / 2)), 2)
            + cos(radians(pickup_latitude)) * cos(radians(dropoff_latitude))
              * pow(sin(radians((dropoff_longitude - pickup_longitude) / 2)), 2)
        ))"""

# One row per trip with everything the products need.
ZONED = f"""{TRIPS},
zoned AS (
    SELECT *, {_zone("pickup")} AS pickup_zone, {_zone("dropoff")} AS dropoff_zone,
        {KM} AS trip_distance_km
    FROM trips
),
measured AS (
    SELECT *,
        CASE WHEN trip_duration > 0
             THEN trip_distance_km / (trip_duration / CAST(3600 AS DOUBLE)) END AS avg_speed
    FROM zoned
)"""

CALENDAR = """
        CAST(extract(hour FROM pickup_datetime) AS INTEGER) AS hour,
        CAST(extract(dow FROM pickup_datetime) AS INTEGER) AS day_of_week,
        extract(dow FROM pickup_datetime) IN (0, 6) AS is_weekend,
        extract(hour FROM pickup_datetime) IN (7, 8, 9, 16, 17, 18) AS is_peak_hour"""

WINDOWS = """
WINDOW
    last_1h AS (PARTITION BY pickup_zone ORDER BY pickup_datetime
                RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
    last_24h AS (PARTITION BY pickup_zone ORDER BY pickup_datetime
                 RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW),
    next_1h AS (PARTITION BY pickup_zone ORDER BY pickup_datetime
                RANGE BETWEEN CURRENT ROW AND INTERVAL 1 HOUR FOLLOWING)"""

# Every rolling column, per trip.
ROLLED = f"""{ZONED},
rolled AS (
    SELECT *,
        count(*) OVER last_1h AS trips_count_1h,
        count(*) OVER last_24h AS trips_count_24h,
        avg(trip_duration) OVER last_1h AS avg_trip_duration_1h,
        avg(trip_duration) OVER last_24h AS avg_trip_duration_24h,
        (count(*) OVER next_1h) - 1 AS trips_count_next_1h
    FROM measured
    {WINDOWS}
)"""


def _level(count: str, high: int, medium: int) -> str:
    return (
        f"CASE WHEN {count} >= {high} THEN 'high' "
        f"WHEN {count} >= {medium} THEN 'medium' ELSE 'low' END AS congestion_level"
    )


def _six(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# Rounded as a decimal number, as its digits print.
def _two(value: str) -> str:
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE)"


ETA = f"""
    SELECT pickup_datetime, dropoff_datetime,
        {_six("pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude")},
        passenger_count, trip_duration, vendor_id, store_and_fwd_flag,
        pickup_zone, dropoff_zone,
        {_six("trip_distance_km", "avg_speed")},
        trips_count_1h, trips_count_24h,
        {_six("avg_trip_duration_1h", "avg_trip_duration_24h")},
        {_level("trips_count_1h", 100, 30)},
        {CALENDAR}
    FROM rolled"""

DEMAND = f"""
    SELECT pickup_datetime, {_six("pickup_longitude", "pickup_latitude")},
        passenger_count, vendor_id, store_and_fwd_flag, pickup_zone,
        trips_count_1h, trips_count_24h, {_six("avg_trip_duration_1h")},
        {_level("trips_count_1h", 100, 30)},
        {CALENDAR},
        trips_count_next_1h
    FROM rolled"""


def _traffic(moment: str, high: int, medium: int) -> str:
    return f"""
WITH {ZONED},
timed AS (SELECT * REPLACE ({moment} AS pickup_datetime) FROM measured),
grouped AS (
    SELECT pickup_zone, pickup_datetime, {CALENDAR},
        count(*) AS total_trips,
        CAST(sum(trip_duration) AS DOUBLE) / count(trip_duration) AS duration,
        avg(trip_distance_km) AS distance,
        avg(avg_speed) AS speed,
        max(avg_speed) AS fastest,
        min(avg_speed) AS slowest,
        CAST(sum(passenger_count) AS DOUBLE) / count(passenger_count) AS passengers
    FROM timed
    GROUP BY ALL
)
SELECT pickup_zone, pickup_datetime, hour, day_of_week, is_weekend, is_peak_hour,
    total_trips,
    {_two("duration")} AS avg_trip_duration_sec,
    {_two("distance")} AS avg_trip_distance_km,
    {_two("speed")} AS avg_speed_kmh,
    {_two("fastest")} AS max_speed_kmh,
    {_two("slowest")} AS min_speed_kmh,
    {_two("passengers")} AS avg_passenger_count,
    {_level("total_trips", high, medium)},
    {_two("total_trips / nullif(speed, 0)")} AS traffic_density_score
FROM grouped"""


# Raw text with defects, cast and judged.
OWN_ID = """CAST(CASE WHEN event_id % 4 = 1 AND event_id >= 1999 THEN event_id - 1999
             ELSE event_id END AS VARCHAR)"""

DIRTY = f"""{TRIPS},
dirty AS (
    SELECT
        event_id + 1 AS raw_id,
        CAST(event_id // 1000 + 1 AS INTEGER) AS batch_no,
        CASE WHEN event_id % 101 = 1 THEN '  '
             WHEN event_id % 103 = 2 THEN NULL
             WHEN event_id % 5 = 0 THEN ' ' || {OWN_ID} || ' '
             ELSE {OWN_ID} END AS id,
        CASE WHEN event_id % 47 = 3 THEN 'x'
             WHEN event_id % 53 = 4 THEN '1.0'
             WHEN event_id % 59 = 5 THEN ' 2 '
             ELSE CAST(vendor_id AS VARCHAR) END AS vendor_id,
        CASE WHEN event_id % 61 = 6 THEN '14/03/2016'
             WHEN event_id % 67 = 7 THEN NULL
             ELSE CAST(pickup_datetime AS VARCHAR) END AS pickup_datetime,
        CASE WHEN event_id % 71 = 8 THEN 'bad'
             WHEN event_id % 73 = 9 THEN '2016-03-14 17:00:00'
             ELSE CAST(dropoff_datetime AS VARCHAR) END AS dropoff_datetime,
        CASE WHEN event_id % 79 = 10 THEN '0'
             WHEN event_id % 83 = 11 THEN '-1'
             WHEN event_id % 89 = 12 THEN NULL
             ELSE CAST(passenger_count AS VARCHAR) END AS passenger_count,
        CASE WHEN event_id % 97 = 13 THEN NULL
             ELSE CAST(pickup_longitude AS VARCHAR) END AS pickup_longitude,
        CASE WHEN event_id % 41 = 14 THEN 'abc'
             ELSE CAST(pickup_latitude AS VARCHAR) END AS pickup_latitude,
        CASE WHEN event_id % 43 = 15 THEN ''
             ELSE CAST(dropoff_longitude AS VARCHAR) END AS dropoff_longitude,
        CASE WHEN event_id % 107 = 16 THEN 'north'
             ELSE CAST(dropoff_latitude AS VARCHAR) END AS dropoff_latitude,
        CASE WHEN event_id % 31 = 17 THEN 'Z'
             WHEN event_id % 37 = 18 THEN NULL
             WHEN event_id % 29 = 19 THEN ' n '
             WHEN event_id % 109 = 20 THEN ''
             ELSE store_and_fwd_flag END AS store_and_fwd_flag,
        CASE WHEN event_id % 113 = 21 THEN '0'
             WHEN event_id % 127 = 22 THEN '1e3'
             WHEN event_id % 131 = 23 THEN NULL
             ELSE CAST(trip_duration AS VARCHAR) END AS trip_duration
    FROM trips
)"""


def _whole(column: str) -> str:
    """A text that is a plain integer, as INTEGER; '1.0' is none."""
    return (
        f"CASE WHEN regexp_full_match(trim({column}), '[+-]?[0-9]+') "
        f"THEN TRY_CAST(trim({column}) AS INTEGER) END AS {column}"
    )


def _as(kind: str, *columns: str) -> str:
    return ", ".join(f"TRY_CAST({c} AS {kind}) AS {c}" for c in columns)


COORDINATES = (
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
)

# Rule text -> condition; NULL conditions do not fire.
BROKEN = {
    "missing id": "id IS NULL OR id = ''",
    "bad vendor_id": "vendor_id IS NULL",
    "bad pickup_datetime": "pickup_datetime IS NULL",
    "bad dropoff_datetime": "dropoff_datetime IS NULL",
    "dropoff before pickup": "dropoff_datetime < pickup_datetime",
    "bad passenger_count": "passenger_count IS NULL OR passenger_count <= 0",
    "bad coordinates": " OR ".join(f"{c} IS NULL" for c in COORDINATES),
    "bad store_and_fwd_flag": "store_and_fwd_flag NOT IN ('Y', 'N')",
    "bad trip_duration": "trip_duration IS NULL OR trip_duration <= 0",
}

ERROR_TEXT = " || ".join(
    f"CASE WHEN {condition} THEN '{rule}; ' ELSE '' END"
    for rule, condition in BROKEN.items()
)

JUDGED = f"""{DIRTY},
typed AS (
    SELECT raw_id, batch_no, trim(id) AS id, {_whole("vendor_id")},
        {_as("TIMESTAMP", "pickup_datetime", "dropoff_datetime")},
        {_whole("passenger_count")},
        {_as("DOUBLE", *COORDINATES)},
        upper(trim(store_and_fwd_flag)) AS store_and_fwd_flag,
        {_whole("trip_duration")}
    FROM dirty
),
judged AS (SELECT *, {ERROR_TEXT} AS validation_error FROM typed),
silver AS (
    SELECT * FROM judged WHERE validation_error = ''
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_no DESC, raw_id DESC) = 1
)"""

TRIP = f"""id, vendor_id, pickup_datetime, dropoff_datetime, passenger_count,
    {_six(*COORDINATES)}, store_and_fwd_flag, trip_duration"""

LINES = """l_orderkey, l_linenumber, l_shipdate, round(l_extendedprice, 6) AS l_extendedprice,
    l_partkey, l_suppkey, round(l_quantity, 6) AS l_quantity"""


def _line_merge(first: str) -> str:
    return f"""
SELECT {LINES}, l_linestatus FROM (
    SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber
        ORDER BY CASE WHEN l_linestatus = '{first}' THEN 0 ELSE 1 END,
            l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC
    ) AS place FROM lineitem
) WHERE place = 1"""


BATCHES = "SELECT DISTINCT CAST(o_orderkey // 1000 + 1 AS INTEGER) AS batch_no FROM orders"
DONE = "SELECT CAST(event_id // 1000 + 1 AS INTEGER) FROM events"
FILES = """
files AS (
    SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) AS file_name, sha256(text) AS file_hash
    FROM documents
)"""

DATE_PARTS = """
    CAST(extract(year FROM date_id) AS INTEGER) AS year,
    CAST(extract(month FROM date_id) AS INTEGER) AS month,
    CAST(extract(day FROM date_id) AS INTEGER) AS day"""

ORACLE: dict[str, str] = {
    "eta_training": f"WITH {ROLLED} {ETA}",
    "demand_prediction": f"WITH {ROLLED} {DEMAND}",
    "traffic_analysis": _traffic("pickup_datetime", 500, 200),
    "traffic_analysis_daily": _traffic(
        "CAST(date_trunc('day', pickup_datetime) AS TIMESTAMP)", 20, 10
    ),
    "heatmap_points": f"""
WITH {TRIPS}
SELECT round(pickup_latitude, 6) AS latitude, round(pickup_longitude, 6) AS longitude
FROM trips WHERE extract(hour FROM pickup_datetime) BETWEEN 6 AND 8""",
    "heatmap_grid": f"""
WITH {ZONED}
SELECT pickup_zone, count(*) AS trips FROM measured
WHERE extract(hour FROM pickup_datetime) BETWEEN 6 AND 8 GROUP BY pickup_zone""",
    "zone_key": f"WITH {ZONED} SELECT id, pickup_zone, dropoff_zone FROM measured",
    "haversine_km": f"WITH {ZONED} SELECT id, {_six('trip_distance_km')} FROM measured",
    "avg_speed": f"WITH {ZONED} SELECT id, {_six('avg_speed')} FROM measured",
    "calendar_features": f"WITH {TRIPS} SELECT id, {CALENDAR} FROM trips",
    "rolling_1h": f"""
WITH {ROLLED}
SELECT id, pickup_zone, trips_count_1h, {_six('avg_trip_duration_1h')} FROM rolled""",
    "rolling_24h": f"""
WITH {ROLLED}
SELECT id, pickup_zone, trips_count_24h, {_six('avg_trip_duration_24h')} FROM rolled""",
    "lookahead_next_1h": f"WITH {ROLLED} SELECT id, pickup_zone, trips_count_next_1h FROM rolled",
    "congestion_level": f"""
WITH {ROLLED} SELECT id, trips_count_1h, {_level('trips_count_1h', 3, 2)} FROM rolled""",
    "silver_clean": f"""
WITH {JUDGED}
SELECT raw_id, id, CAST(vendor_id AS DOUBLE) AS vendor_id, pickup_datetime,
    dropoff_datetime, CAST(passenger_count AS DOUBLE) AS passenger_count,
    {_six(*COORDINATES)}, store_and_fwd_flag, CAST(trip_duration AS DOUBLE) AS trip_duration
FROM judged""",
    "silver_validate": f"""
WITH {JUDGED}
SELECT raw_id, id, validation_error, validation_error = '' AS is_valid FROM judged""",
    "silver_rejects": f"""
WITH {JUDGED}
SELECT raw_id, batch_no, validation_error FROM judged WHERE validation_error <> ''""",
    "invalid_rule_counts": f"WITH {JUDGED} "
    + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) AS rows FROM judged WHERE {condition}"
        for rule, condition in BROKEN.items()
    ),
    "silver_build": f"""
WITH {JUDGED}
SELECT batch_no, 'events' AS source_file, sha256('events') AS file_hash, {TRIP},
    true AS is_valid, validation_error
FROM silver QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_no DESC, raw_id DESC) = 1""",
    "silver_last_write_wins": f"""
SELECT {LINES} FROM lineitem
QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC
) = 1""",
    "upsert_silver": _line_merge("O"),
    "upsert_keep_stored": _line_merge("F"),
    "dim_vendor": f"WITH {JUDGED} SELECT DISTINCT vendor_id FROM silver",
    "dim_date": f"""
WITH {JUDGED}, dates AS (SELECT DISTINCT CAST(pickup_datetime AS DATE) AS date_id FROM silver)
SELECT CAST(date_id AS VARCHAR) AS date_id, {DATE_PARTS} FROM dates""",
    "dim_date_orders": f"""
WITH dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date_id FROM orders)
SELECT CAST(date_id AS VARCHAR) AS date_id, {DATE_PARTS} FROM dates""",
    "fact_trips": f"""
WITH {JUDGED}
SELECT {TRIP}, CAST(CAST(pickup_datetime AS DATE) AS VARCHAR) AS date_id FROM silver""",
    "v_trip_report": f"""
WITH {JUDGED},
dates AS (
    SELECT date_id, {DATE_PARTS}
    FROM (SELECT DISTINCT CAST(pickup_datetime AS DATE) AS date_id FROM silver)
)
SELECT {TRIP}, year, month, day
FROM silver JOIN dates ON CAST(pickup_datetime AS DATE) = date_id""",
    "upsert_fact": f"""
WITH {TRIPS},
corrections AS (
    SELECT CAST(event_id * 2 AS VARCHAR) AS id, vendor_id, pickup_datetime,
        trip_duration + 60 AS trip_duration
    FROM trips
)
SELECT * FROM corrections
UNION ALL
SELECT id, vendor_id, pickup_datetime, trip_duration FROM trips
WHERE NOT EXISTS (SELECT 1 FROM corrections WHERE corrections.id = trips.id)""",
    "distinct_batches": BATCHES,
    "max_batch_no": f"SELECT coalesce(max(batch_no), 0) AS max_batch_no FROM ({BATCHES})",
    "pending_batches": f"SELECT batch_no FROM ({BATCHES}) WHERE batch_no NOT IN ({DONE})",
    "batch_scan": f"""
SELECT CAST(o_orderkey // 1000 + 1 AS INTEGER) AS batch_no, o_orderkey, o_custkey,
    round(o_totalprice, 6) AS o_totalprice
FROM orders WHERE CAST(o_orderkey // 1000 + 1 AS INTEGER) NOT IN ({DONE})""",
    "batch_equality": f"""
WITH pending AS (
    SELECT max(batch_no) AS last FROM ({BATCHES}) WHERE batch_no NOT IN ({DONE})
)
SELECT CAST(o_orderkey // 1000 + 1 AS INTEGER) AS batch_no, o_orderkey, o_custkey,
    round(o_totalprice, 6) AS o_totalprice
FROM orders, pending WHERE CAST(o_orderkey // 1000 + 1 AS INTEGER) = last""",
    "batch_assignment": """
SELECT o_orderkey, o_custkey,
    CAST(42 + (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS INTEGER) AS batch_no
FROM orders""",
    "sha256_fingerprint": f"WITH {FILES} SELECT doc_id, file_hash FROM files",
    "incremental_new_files": f"""
WITH {FILES}
SELECT doc_id, file_name, file_hash FROM files
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "first_deliveries": """
SELECT min(doc_id) AS doc_id, source AS file_name, sha256(text) AS file_hash
FROM documents GROUP BY source, sha256(text)""",
    "export_latest_n": f"""
WITH {ROLLED} {ETA} ORDER BY pickup_datetime DESC NULLS FIRST LIMIT 1000""",
    "export_all_sorted": f"""
WITH {ROLLED} {DEMAND} ORDER BY pickup_datetime DESC NULLS FIRST""",
}
