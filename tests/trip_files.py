"""Small trip CSV files for the tests."""

from hackney.schemas import TRIP_COLUMNS

BASE = {
    "id": "t1",
    "vendor_id": "1",
    "pickup_datetime": "2016-03-14 17:24:55",
    "dropoff_datetime": "2016-03-14 17:32:30",
    "passenger_count": "1",
    "pickup_longitude": "-73.98",
    "pickup_latitude": "40.76",
    "dropoff_longitude": "-73.96",
    "dropoff_latitude": "40.76",
    "store_and_fwd_flag": "N",
    "trip_duration": "455",
}


def trip(**changes):
    return BASE | changes


def csv_text(rows):
    lines = [",".join(TRIP_COLUMNS)]
    lines += [
        ",".join("" if row[c] is None else row[c] for c in TRIP_COLUMNS) for row in rows
    ]
    return "\n".join(lines) + "\n"


def write_csv(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(csv_text(rows))
    return path


def many(count, start=0, **changes):
    """``count`` valid trips, one per minute from midnight."""
    rows = []
    for n in range(start, start + count):
        minute = f"{n // 60 % 24:02d}:{n % 60:02d}"
        rows.append(
            trip(
                id=f"m{n}",
                vendor_id=str(1 + n % 2),
                pickup_datetime=f"2016-03-14 {minute}:00",
                dropoff_datetime=f"2016-03-14 {minute}:59",
                trip_duration="59",
            )
            | changes
        )
    return rows
