"""Rolling statistics against the plain RANGE window and against a Python loop."""

import random
from datetime import datetime, timedelta

import pytest

from hackney.operators.rolling import Frame, rolling_statistics

HOUR, DAY = timedelta(hours=1), timedelta(hours=24)
FRAMES = [
    Frame("n1", back=HOUR, average="a1"),
    Frame("n24", back=DAY, average="a24"),
    Frame("next", ahead=HOUR),
]
COLUMNS = ["id", "n1", "a1", "n24", "a24", "next"]
START = datetime(2024, 2, 28, 22, 0, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, zone string, t timestamp_ntz, v int")


def plain(spark, rows):
    frame(spark, rows).createOrReplaceTempView("rolling_rows")
    over = "OVER (PARTITION BY zone ORDER BY t RANGE BETWEEN {} AND {})"
    back1 = over.format("INTERVAL '1' HOUR PRECEDING", "CURRENT ROW")
    back24 = over.format("INTERVAL '24' HOUR PRECEDING", "CURRENT ROW")
    ahead = over.format("CURRENT ROW", "INTERVAL '1' HOUR FOLLOWING")
    return spark.sql(
        f"SELECT id, count(*) {back1} n1, avg(v) {back1} a1, count(*) {back24} n24,"
        f" avg(v) {back24} a24, count(*) {ahead} next FROM rolling_rows ORDER BY id"
    ).collect()


def ours(spark, rows, **options):
    rolled = rolling_statistics(frame(spark, rows), "zone", "t", FRAMES, "v", **options)
    return rolled.select(*COLUMNS).orderBy("id").collect()


def test_frame_edges_and_ties(spark):
    t = START
    tick = timedelta(microseconds=1)
    moments = [t, t, t + HOUR, t + HOUR + tick, t + DAY, t + DAY + tick, t - tick]
    rows = [(n, "z", moment, 10 * n) for n, moment in enumerate(moments)]
    got = {r.id: r for r in ours(spark, rows)}
    assert (got[0].n1, got[1].n1) == (3, 3)
    assert got[2].n1 == 3  # exactly one hour later: both are inside
    assert got[3].n1 == 2  # a microsecond more: both are outside
    assert (got[4].n24, got[5].n24) == (5, 4)
    assert (got[0].next, got[6].next) == (3, 3)
    assert [tuple(r) for r in ours(spark, rows)] == [tuple(r) for r in plain(spark, rows)]


@pytest.mark.parametrize("seed,slice_seconds", [(1, 60), (2, 7), (3, 86400)])
def test_random_rows_equal_the_plain_window(spark, seed, slice_seconds):
    pick = random.Random(seed)
    rows = []
    for n in range(1500):
        # One zone holds most rows; whole half-hours make ties and edge hits.
        zone = "hot" if pick.random() < 0.6 else pick.choice(["a", "b", None])
        moment = START + timedelta(minutes=30 * pick.randrange(150))
        if pick.random() < 0.5:
            moment += timedelta(microseconds=pick.randrange(-2, 3))
        value = None if pick.random() < 0.05 else pick.randrange(-50, 5000)
        rows.append((n, zone, None if pick.random() < 0.02 else moment, value))
    got = ours(spark, rows, slice_seconds=slice_seconds)
    assert [tuple(r) for r in got] == [tuple(r) for r in plain(spark, rows)]


def test_before_the_epoch(spark):
    start = datetime(1969, 12, 31, 23, 59, 30)
    rows = [(n, "z", start + timedelta(seconds=13 * n), n) for n in range(600)]
    got = ours(spark, rows)
    assert [tuple(r) for r in got] == [tuple(r) for r in plain(spark, rows)]


def test_brute_force(spark):
    pick = random.Random(7)
    rows = [
        (n, pick.choice("xy"), START + timedelta(minutes=pick.randrange(4000)), n)
        for n in range(200)
    ]
    for r in ours(spark, rows):
        _, zone, t, _ = rows[r.id]
        day = [v for _, z, s, v in rows if z == zone and t - DAY <= s <= t]
        assert r.n24 == len(day) and r.a24 == sum(day) / len(day)
        assert r.next == sum(1 for _, z, s, _ in rows if z == zone and t <= s <= t + HOUR)


def test_a_hot_instant_splits_in_the_join(spark):
    """A third of all rows share zone and instant; the join spreads that key."""
    from pyspark.sql import functions as F

    n = 300_000
    rows = spark.range(0, n, 1, 8).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("zone"),
        F.when(F.col("id") % 3 == 0, F.lit(START)).otherwise(
            F.lit(START) + F.make_dt_interval(secs=F.col("id") % 50_000)
        ).cast("timestamp_ntz").alias("t"),
        F.lit(1).alias("v"),
        F.sha2(F.col("id").cast("string"), 512).alias("payload"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128KB",
    }
    old = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rolled = rolling_statistics(rows, "zone", "t", FRAMES[:1], "v")
        # An action that leaves the frame's own adaptive plan executed.
        assert rolled.where("zone = 'hot'").select("n1").distinct().collect() == [(n // 3,)]
        rolled.collect()
        plan = rolled._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    assert "isFinalPlan=true" in plan and "skew=true" in plan


def test_frame_arguments():
    with pytest.raises(ValueError, match="back or ahead"):
        Frame("n")
    with pytest.raises(ValueError, match="back or ahead"):
        Frame("n", back=HOUR, ahead=HOUR)
    with pytest.raises(ValueError, match="averages"):
        Frame("n", ahead=HOUR, average="a")
