import random

import pytest

from hackney.operators import Ranges, as_numbers, as_ranges, pending_ranges
from hackney.plans.silver import batch_log, log_batches, logged_ranges

ENDS = "first_batch int, last_batch int"


def numbers(ranges):
    return {n for first, last in ranges for n in range(first, last + 1)}


@pytest.mark.parametrize("seed", range(4))
def test_difference_equals_sets_of_numbers(spark, seed):
    pick = random.Random(seed)

    def side(count):
        firsts = [pick.randrange(-40, 200) for _ in range(count)]
        return [(first, first + pick.choice([0, 0, 3, 25])) for first in firsts]

    left, right = side(pick.choice([0, 5, 12])), side(pick.choice([0, 1, 12]))
    frames = [spark.createDataFrame(rows, ENDS) for rows in (left, right)]
    want = numbers(left) - numbers(right)
    whole, cut = (pending_ranges(*frames, slice_width=width) for width in (10**6, 7))
    for got in (whole, cut):
        assert got.schema == frames[0].schema or got.dtypes == frames[0].dtypes
        rows = [tuple(r) for r in got.collect()]
        assert all(first <= last for first, last in rows)
        assert sum(last - first + 1 for first, last in rows) == len(want)
        assert numbers(rows) == want
    assert sorted(r.batch_no for r in as_numbers(cut).collect()) == sorted(want)
    # Those below and above zero are slices of their own; otherwise touching ranges are one.
    held = Ranges(map(tuple, whole.collect()))
    assert whole.count() <= len(held.ranges) + 1
    assert held == sorted(want) and held == Ranges(map(tuple, cut.collect()))


def test_null_numbers_and_ranges_without_numbers(spark):
    batches = spark.createDataFrame([(1,), (None,), (3,), (3,)], "batch_no int")
    assert sorted(map(tuple, as_ranges(batches).collect())) == [(1, 1), (3, 3), (3, 3)]
    odd = spark.createDataFrame([(5, 4), (None, 2), (1, None)], ENDS)
    assert pending_ranges(odd, odd).collect() == []
    got = pending_ranges(as_ranges(batches), odd).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 3)]


def test_ranges_are_a_sequence():
    held = Ranges([(7, 9), (1, 2), (3, 3), (8, 12)])
    assert held == [1, 2, 3, 7, 8, 9, 10, 11, 12] and held == Ranges([(1, 3), (7, 12)])
    assert held != [1, 2] and held != Ranges([]) and held != "x"
    assert len(held) == 9 and held[0] == 1 and held[3] == 7 and held[-1] == 12 and held[1:3] == [2, 3]
    with pytest.raises(IndexError):
        held[9]
    assert 8 in held and 5 not in held and repr(held) == "Ranges([(1, 3), (7, 12)])"
    assert not Ranges([]) and Ranges([]) == []
    assert held.overlap(3, 6) and held.overlap(0, 1) and held.overlap(0, 99) and held.overlap(12, 13)
    assert not held.overlap(4, 6) and not held.overlap(13, 20) and not held.overlap(-5, 0)


def test_the_log_keeps_the_first_time_of_a_batch(spark, tmp_path):
    base = str(tmp_path)
    log_batches(spark, base, spark.createDataFrame([(1, 4)], ENDS))
    first = {r.batch_no: r.processed_at for r in batch_log(spark, base).collect()}
    log_batches(spark, base, spark.createDataFrame([(3, 6), (9, 9)], ENDS))
    log_batches(spark, base, spark.createDataFrame([(2, 2)], ENDS))
    log = {r.batch_no: r.processed_at for r in batch_log(spark, base).collect()}
    assert sorted(log) == [1, 2, 3, 4, 5, 6, 9] and batch_log(spark, base).count() == 7
    assert {n: log[n] for n in first} == first
    assert logged_ranges(spark, base).count() == 3
    # A log of single batches, written by an older version, counts as processed.
    old = spark.sql("SELECT 7 AS batch_no, TIMESTAMP'2024-01-01' AS processed_at")
    old.write.parquet(f"{base}/silver/batch_log")
    log_batches(spark, base, spark.createDataFrame([(6, 8)], ENDS))
    assert sorted(r.batch_no for r in batch_log(spark, base).collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
