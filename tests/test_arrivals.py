"""What a run reads again, and what becomes of files that fail or change in place."""

import os
import time

import pytest
from trip_files import csv_text, many, write_csv

from hackney.plans import ingest as plan
from hackney.plans.gold import fact_trips
from hackney.plans.ingest import file_states, ingest, transactions_raw
from hackney.streaming.arrivals import failed_arrivals, process_arrivals

B = 4


def aged(path, seconds=1000):
    """Sets the time of change back, so that it counts as settled."""
    then = time.time() - seconds
    os.utime(path, (then, then))
    return path


def reads(monkeypatch):
    """The file names whose content is read from now on."""
    seen, real = [], plan.fingerprint

    def spied(spark, files, *args):
        seen.extend(sorted(row.file_name for row in files.collect()))
        return real(spark, files, *args)

    monkeypatch.setattr(plan, "fingerprint", spied)
    return seen


def test_a_second_run_reads_no_content(spark, tmp_path, monkeypatch):
    for name in "ab":
        aged(write_csv(tmp_path / f"in/{name}.csv", many(3, start=ord(name))))
    source, wh = str(tmp_path / "in"), str(tmp_path / "wh")
    first = ingest(spark, source, wh)
    seen = reads(monkeypatch)
    again = ingest(spark, source, wh)
    assert seen == [] and not again.should_continue
    assert again.skipped_files == first.processed_files
    aged(write_csv(tmp_path / "in/c.csv", many(2, start=300)))
    assert [os.path.basename(p) for p in ingest(spark, source, wh).processed_files] == ["c.csv"]
    assert seen == ["c.csv"]
    assert ingest(spark, source, wh, recheck=True).processed_files == []
    assert seen == ["c.csv", "a.csv", "b.csv", "c.csv"]
    assert transactions_raw(spark, wh).count() == 8


def test_same_length_other_content_is_told_by_its_time(spark, tmp_path, monkeypatch):
    path = aged(write_csv(tmp_path / "in/a.csv", many(3, start=100)))
    source, wh = str(tmp_path / "in"), str(tmp_path / "wh")
    ingest(spark, source, wh)
    length = path.stat().st_size
    aged(write_csv(path, many(3, start=200)), 900)
    assert path.stat().st_size == length
    assert len(ingest(spark, source, wh).processed_files) == 1
    assert transactions_raw(spark, wh).count() == 6


def test_a_file_that_has_just_changed_is_read_again(spark, tmp_path, monkeypatch):
    # it could change once more without its length and time showing it
    path = write_csv(tmp_path / "in/a.csv", many(3, start=100))
    source, wh = str(tmp_path / "in"), str(tmp_path / "wh")
    ingest(spark, source, wh)
    assert [row.settled for row in file_states(spark, wh).collect()] == [False]
    stat = path.stat()
    write_csv(path, many(3, start=200))
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert len(ingest(spark, source, wh).processed_files) == 1


@pytest.mark.parametrize("name", ["_a.csv", ".a.csv"])
def test_a_single_file_that_spark_hides_is_an_error(spark, tmp_path, name):
    path = write_csv(tmp_path / name, many(1))
    with pytest.raises(ValueError, match="begins with"):
        ingest(spark, None, str(tmp_path / "wh"), file=str(path))


@pytest.fixture
def stream(spark, tmp_path):
    def go():
        process_arrivals(
            spark, str(tmp_path / "in"), str(tmp_path / "wh"), str(tmp_path / "cp"), 10, B
        ).awaitTermination(180)
        facts = fact_trips(spark, str(tmp_path / "wh"), B).read().count()
        failed = failed_arrivals(spark, str(tmp_path / "wh")).collect()
        return facts, {os.path.basename(row.path): row.reason for row in failed}

    return go


def test_failed_arrivals_are_named_and_tried_again(spark, tmp_path, stream):
    write_csv(tmp_path / "in/good.csv", many(4))
    bad = tmp_path / "in/bad.csv"
    bad.write_text(csv_text(many(3, start=50)).replace("vendor_id", "vendor"))
    write_csv(tmp_path / "in/_hidden.csv", many(2, start=90))
    facts, failed = stream()
    assert facts == 4 and sorted(failed) == ["_hidden.csv", "bad.csv"]
    assert "vendor" in failed["bad.csv"] and "begins with" in failed["_hidden.csv"]
    assert stream() == (4, failed)  # still bad, still there
    bad.write_text(csv_text(many(3, start=50)))
    (tmp_path / "in/_hidden.csv").rename(tmp_path / "in/shown.csv")
    assert stream() == (9, {})
    assert stream() == (9, {})


def test_a_file_rewritten_in_place_is_loaded_by_the_stream(spark, tmp_path, stream):
    path = aged(write_csv(tmp_path / "in/a.csv", many(3)))
    assert stream() == (3, {})
    aged(write_csv(path, many(5)), 500)
    assert stream() == (5, {})
    rows = transactions_raw(spark, str(tmp_path / "wh")).count()
    assert stream() == (5, {})
    assert transactions_raw(spark, str(tmp_path / "wh")).count() == rows == 8
