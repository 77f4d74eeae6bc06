import random
from datetime import datetime, timedelta

import pytest

from hackney.operators.selection import newest_span
from hackney.plans import export
from hackney.plans.export import _first_rows, newest_first

START = datetime(1969, 12, 31, 23, 50)


def moments(spark, rows, kind="timestamp_ntz"):
    return spark.createDataFrame(rows, f"pickup_datetime {kind}, n int").repartition(4)


@pytest.mark.parametrize("n", [1, 7, 60, 299])
@pytest.mark.parametrize("bins", [2, 1024])
def test_the_span_holds_the_nth_newest_row(spark, n, bins):
    pick = random.Random(n)
    times = [START + timedelta(seconds=int(pick.expovariate(1 / 3000))) for _ in range(300)]
    span = newest_span(moments(spark, [(t, k) for k, t in enumerate(times)]), "pickup_datetime", n, bins)
    at = sorted(((t - datetime(1970, 1, 1)).total_seconds() for t in times), reverse=True)
    assert span.above == sum(t >= span.high for t in at)
    assert span.inside == sum(span.low <= t < span.high for t in at)
    assert span.low <= at[n - 1] < span.high and span.above < n
    assert span.inside <= n / 8 or span.high - span.low == 1


def test_spans_of_few_rows_and_of_missing_times(spark):
    rows = moments(spark, [(None, k) for k in range(5)] + [(START, 9)])
    assert newest_span(rows, "pickup_datetime", 6) is None
    assert newest_span(rows.limit(0), "pickup_datetime", 1) is None
    span = newest_span(rows, "pickup_datetime", 3)
    assert (span.low, span.high, span.above, span.inside) == (None, None, 0, 5)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_first_rows_equal_the_prefix_of_the_full_sort(spark, tmp_path, kind):
    # A third of all rows at one moment, some without a time, fractions of seconds, an hour
    # that daylight saving repeats.
    pick = random.Random(5)
    hot = datetime(2024, 11, 3, 1, 30)
    times = [hot] * 100 + [None] * 15
    times += [hot + timedelta(seconds=pick.randrange(-7200, 7200), microseconds=pick.randrange(10**6)) for _ in range(185)]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = moments(spark, [(t, k) for k, t in enumerate(times)], kind)
        want = newest_first(rows, export.ALL_ROWS).collect()
        for n in (1, 14, 15, 16, 90, 150, 260, 300, 400):
            assert _first_rows(rows, n, str(tmp_path / "s")).collect() == want[:n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_rows_older_than_the_span_are_not_sorted(spark, tmp_path):
    rows = moments(spark, [(START + timedelta(minutes=k), k) for k in range(5000)])
    got = _first_rows(rows, 100, str(tmp_path / "s"))
    child = got._jdf.queryExecution().optimizedPlan()
    while child.nodeName() != "Sort":
        child = child.children().apply(0)
    below = child.children().apply(0)
    sorted_rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, below).count()
    assert got.count() == 100 == sorted_rows
    # The rows sorted to be cut: a bin of at most an eighth of the limit.
    assert spark.read.parquet(str(tmp_path / "s/last")).count() <= 13
