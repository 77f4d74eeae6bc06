import hashlib
import os

import pytest

from hackney.plans.gold import dim_date, dim_vendor, fact_trips, v_trip_report
from hackney.plans.ingest import (
    ingest,
    ingestion_log,
    load_log,
    numbered_rows,
    raw_batch,
    split_offsets,
    transactions_raw,
)
from hackney.plans.pipeline import run_pipeline
from hackney.plans.silver import batch_log, build_silver, rejects, silver_table
from hackney.sources.tables import KeyedTable
from hackney.streaming.arrivals import process_arrivals
from trip_files import csv_text, many, trip, write_csv

B = 2


def run(spark, base, **options):
    return run_pipeline(
        spark, str(base / "in"), str(base / "wh"), buckets=B, **({"chunk_size": 10} | options)
    )


def test_batches_follow_the_order_of_files_and_rows(spark, tmp_path):
    write_csv(tmp_path / "in/b.csv", many(25, start=100))
    write_csv(tmp_path / "in/sub/c d.CSV", many(3, start=200))
    write_csv(tmp_path / "in/a.csv", many(12))
    (tmp_path / "in/notes.txt").write_text("no trips")
    result = ingest(spark, str(tmp_path / "in"), str(tmp_path / "wh"), chunk_size=10)
    assert [os.path.basename(p) for p in result.processed_files] == ["a.csv", "b.csv", "c d.CSV"]
    rows = transactions_raw(spark, str(tmp_path / "wh")).orderBy("raw_id").collect()
    assert [r.raw_id for r in rows] == list(range(1, 41))
    assert [r.id for r in rows] == [
        f"m{n}" for n in [*range(12), *range(100, 125), *range(200, 203)]
    ]
    batches = [1] * 10 + [2] * 2 + [3] * 10 + [4] * 10 + [5] * 5 + [6] * 3
    assert [r.batch_no for r in rows] == batches
    digest = hashlib.sha256((tmp_path / "in/a.csv").read_bytes()).hexdigest()
    assert {r.file_hash for r in rows if r.source_file == "a.csv"} == {digest}


def test_numbering_across_many_splits(spark, tmp_path):
    write_csv(tmp_path / "in/big.csv", many(3000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 9000)
    try:
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "wh"), chunk_size=700)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = transactions_raw(spark, str(tmp_path / "wh")).orderBy("raw_id").collect()
    assert [r.id for r in rows] == [f"m{n}" for n in range(3000)]
    assert [r.raw_id for r in rows] == list(range(1, 3001))
    assert [r.batch_no for r in rows] == [1 + n // 700 for n in range(3000)]


def swap_columns(text):
    """The same rows with another header: the first two columns change places."""
    lines = [line.split(",") for line in text.splitlines()]
    return "\n".join(",".join([b, a, *rest]) for a, b, *rest in lines) + "\n"


def test_raw_is_written_once_and_not_shuffled(spark, tmp_path, monkeypatch):
    for n in range(4):
        write_csv(tmp_path / f"in/f{n}.csv", many(400, start=1000 * n))
    (tmp_path / "in/f2.csv").write_text(swap_columns(csv_text(many(400, start=2000))))
    (tmp_path / "in/f1x.csv").write_text(csv_text(many(300)) + "a," * 20 + "\n")
    plans = []

    def noted(*args):
        rows = numbered_rows(*args)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr("hackney.plans.ingest.numbered_rows", noted)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 9000)
    got = []
    try:
        for name, limit in (("a", 500_000), ("b", 0)):
            monkeypatch.setattr("hackney.plans.ingest.BROADCAST_SPLITS", limit)
            result = ingest(spark, str(tmp_path / "in"), str(tmp_path / name), chunk_size=150)
            assert [os.path.basename(p) for p in result.failed_files] == ["f1x.csv"]
            rows = transactions_raw(spark, str(tmp_path / name)).orderBy("raw_id").collect()
            got.append([(r.raw_id, r.batch_no, r.id, r.vendor_id) for r in rows])
            assert not list((tmp_path / name / "raw/stage").iterdir())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    ids = [f"m{1000 * n + k}" for n in range(4) for k in range(400)]
    want = [(k + 1, 1 + k // 400 * 3 + k % 400 // 150, i, str(1 + k % 2)) for k, i in enumerate(ids)]
    assert got == [want, want]
    # The rows go from the scan to the file; only offsets of splits are exchanged.
    join = plans[0].index("BroadcastHashJoin")
    assert "SortMergeJoin" not in plans[0] and "BroadcastExchange" in plans[0][join:]
    scan = plans[0][: plans[0].index("BroadcastExchange")]
    assert "Scan csv" in scan and "Exchange" not in scan


def test_a_file_that_changes_while_it_is_loaded_is_not_committed(spark, tmp_path, monkeypatch):
    path = write_csv(tmp_path / "in/a.csv", many(50))
    wh = tmp_path / "wh"

    def shrunk(*args):
        write_csv(path, many(40))
        return split_offsets(*args)

    with monkeypatch.context() as patch:
        patch.setattr("hackney.plans.ingest.split_offsets", shrunk)
        with pytest.raises(OSError, match="changed while"):
            ingest(spark, str(tmp_path / "in"), str(wh))
    assert load_log(spark, str(wh)).count() == 0
    assert not list((wh / "raw/transactions_raw").iterdir())
    assert ingest(spark, str(tmp_path / "in"), str(wh)).processed_files
    assert transactions_raw(spark, str(wh)).count() == 40


def test_second_run_changes_nothing(spark, tmp_path):
    write_csv(tmp_path / "in/a.csv", many(12))
    first = run(spark, tmp_path)
    assert first.silver_batches == [1, 2] and first.gold_built
    before = silver_table(spark, str(tmp_path / "wh"), B).read().orderBy("id").collect()
    second = run(spark, tmp_path)
    assert second.raw.processed_files == [] and len(second.raw.skipped_files) == 1
    assert not second.raw.should_continue
    assert second.silver_batches == [] and not second.gold_built
    after = silver_table(spark, str(tmp_path / "wh"), B).read().orderBy("id").collect()
    assert before == after
    assert load_log(spark, str(tmp_path / "wh")).count() == 1


def test_ledger_is_by_name_and_content(spark, tmp_path):
    rows = many(3)
    write_csv(tmp_path / "in/a.csv", rows)
    write_csv(tmp_path / "in/again/a.csv", rows)
    first = run(spark, tmp_path)
    # Same name and bytes in another folder counts as loaded already.
    assert len(first.raw.processed_files) == 1 and len(first.raw.skipped_files) == 1
    # A new name for the same bytes is a new file; so are new bytes.
    write_csv(tmp_path / "in/b.csv", rows)
    write_csv(tmp_path / "in/a.csv", many(4))
    second = run(spark, tmp_path)
    assert sorted(map(os.path.basename, second.raw.processed_files)) == ["a.csv", "b.csv"]
    assert second.silver_batches == [2, 3]
    assert ingestion_log(spark, str(tmp_path / "wh")).count() == 3


def test_full_mode_appends_again_and_keeps_one_row_per_id(spark, tmp_path):
    write_csv(tmp_path / "in/a.csv", many(12))
    run(spark, tmp_path)
    result = run(spark, tmp_path, load_mode="full")
    wh = str(tmp_path / "wh")
    assert result.raw.should_continue and result.silver_batches == [1, 2, 3, 4]
    assert transactions_raw(spark, wh).count() == 24
    assert silver_table(spark, wh, B).read().count() == 12
    assert ingestion_log(spark, wh).count() == 1
    assert batch_log(spark, wh).count() == 4
    assert fact_trips(spark, wh, B).read().count() == 12


def test_later_batch_wins_and_an_invalid_update_keeps_the_old_row(spark, tmp_path):
    write_csv(tmp_path / "in/1.csv", [trip(id="a"), trip(id="b")])
    run(spark, tmp_path)
    write_csv(
        tmp_path / "in/2.csv",
        [
            trip(id="a", passenger_count="3"),
            trip(id="c"),
            trip(id="b", passenger_count="0"),
            trip(id="c", passenger_count="5"),
        ],
    )
    run(spark, tmp_path)
    wh = str(tmp_path / "wh")
    for table in (silver_table(spark, wh, B), fact_trips(spark, wh, B)):
        counts = {r.id: r.passenger_count for r in table.read().collect()}
        assert counts == {"a": 3, "b": 1, "c": 5}
    batches = {r.id: r.batch_no for r in silver_table(spark, wh, B).read().collect()}
    assert batches == {"a": 2, "b": 1, "c": 2}
    assert [(r.id, r.validation_error) for r in rejects(spark, wh).collect()] == [
        ("b", "bad passenger_count; ")
    ]


def test_all_pending_batches_at_once_equal_one_by_one(spark, tmp_path):
    chunks = [
        [trip(id=f"k{n % 4}", passenger_count=str((n * m) % 3), trip_duration=str(n + m)) for n in range(8)]
        for m in (1, 2, 3)
    ]
    for number, rows in enumerate(chunks):
        write_csv(tmp_path / f"one/in/{number}.csv", rows)
        run(spark, tmp_path / "one", chunk_size=3)
        write_csv(tmp_path / f"all/in/{number}.csv", rows)
    run(spark, tmp_path / "all", chunk_size=3)
    one, both = (
        silver_table(spark, str(tmp_path / d / "wh"), B).read().drop("updated_at").orderBy("id").collect()
        for d in ("one", "all")
    )
    assert one == both and len(one) == 4


def test_strict_refuses_an_id_twice_in_a_batch(spark, tmp_path):
    write_csv(tmp_path / "in/a.csv", [trip(id="a"), trip(id="a")])
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "wh"))
    with pytest.raises(ValueError, match="occurs twice"):
        build_silver(spark, str(tmp_path / "wh"), buckets=B, strict=True)
    assert batch_log(spark, str(tmp_path / "wh")).count() == 0
    assert build_silver(spark, str(tmp_path / "wh"), buckets=B) == [1]


def test_a_crash_between_data_and_log_is_repaired(spark, tmp_path, monkeypatch):
    write_csv(tmp_path / "in/a.csv", many(5))
    wh = str(tmp_path / "wh")

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("hackney.plans.ingest.append_small", fail)
        with pytest.raises(OSError):
            run(spark, tmp_path)
    # The rows lie on disk, but no log entry makes them visible.
    assert transactions_raw(spark, wh).count() == 0
    with monkeypatch.context() as patch:
        patch.setattr("hackney.plans.silver.log_batches", fail)
        with pytest.raises(OSError):
            run(spark, tmp_path)
    assert transactions_raw(spark, wh).count() == 5
    result = run(spark, tmp_path)
    assert result.raw.processed_files == [] and result.silver_batches == [1]
    assert fact_trips(spark, wh, B).read().count() == 5


def test_single_file_ignores_the_suffix(spark, tmp_path):
    write_csv(tmp_path / "in/a.csv", many(2))
    path = write_csv(tmp_path / "other/trips.data", many(3))
    result = run(spark, tmp_path, file=str(path))
    assert len(result.raw.processed_files) == 1
    assert transactions_raw(spark, str(tmp_path / "wh")).count() == 3


def test_nothing_to_load(spark, tmp_path):
    (tmp_path / "in").mkdir()
    result = run(spark, tmp_path)
    assert not result.raw.should_continue and result.silver_batches == []
    assert not ingest(spark, str(tmp_path / "absent"), str(tmp_path / "wh")).should_continue
    write_csv(tmp_path / "in/header_only.csv", [])
    assert len(run(spark, tmp_path).raw.processed_files) == 1
    assert run(spark, tmp_path).raw.processed_files == []


def test_bad_arguments_and_headers(spark, tmp_path):
    with pytest.raises(ValueError, match="load_mode"):
        run(spark, tmp_path, load_mode="partial")
    write_csv(tmp_path / "in/a.csv", many(1))
    with pytest.raises(ValueError, match="chunk_size"):
        run(spark, tmp_path, chunk_size=0)
    text = csv_text(many(2)).replace("vendor_id", "company")
    (tmp_path / "in/a.csv").write_text(text)
    failed = run(spark, tmp_path).raw.failed_files
    assert [os.path.basename(p) for p in failed] == ["a.csv"]
    assert "company" in next(iter(failed.values()))


def test_rows_of_a_wrong_length(spark, tmp_path):
    wh = str(tmp_path / "wh")
    text = csv_text(many(3)) + "short,1\n"
    quoted = csv_text([trip(id='"q,x"')])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(text + quoted.splitlines()[1] + "\n")
    ingest(spark, str(tmp_path / "in"), wh)
    rows = {r.id: (r.vendor_id, r.trip_duration) for r in transactions_raw(spark, wh).collect()}
    assert len(rows) == 5 and rows["short"] == ("1", None) and rows["q,x"] == ("1", "455")
    (tmp_path / "in/b.csv").write_text(csv_text(many(1)).rstrip() + ",more\n")
    write_csv(tmp_path / "in/c.csv", many(4, start=50))
    for _ in range(2):  # the bad file alone fails, again each time
        failed = ingest(spark, str(tmp_path / "in"), wh).failed_files
        assert [os.path.basename(p) for p in failed] == ["b.csv"]
        assert "more fields" in next(iter(failed.values()))
        assert transactions_raw(spark, wh).count() == 9
    (tmp_path / "in/b.csv").write_text(csv_text(many(1)))
    assert ingest(spark, str(tmp_path / "in"), wh).failed_files == {}
    assert transactions_raw(spark, wh).count() == 10


def test_file_names_that_look_like_patterns(spark, tmp_path):
    names = ["t1.csv", "t[12].csv", "a{b}.csv", "q?.csv", "s*.csv", "b\\c.csv", "x%20 y.csv"]
    for n, name in enumerate(names):
        write_csv(tmp_path / "i[n]" / name, many(n + 1, start=100 * n))
    hidden = ["_x.csv", ".x.csv", "_d/y.csv", "sub/_z.CSV"]
    for name in hidden:
        write_csv(tmp_path / "i[n]" / name, many(1))
    write_csv(tmp_path / "i[n]/sub/deep/w.csv", many(2, start=900))
    wh = str(tmp_path / "wh")
    result = ingest(spark, str(tmp_path / "i[n]"), wh)
    want = {name: n + 1 for n, name in enumerate(names)} | {"w.csv": 2}
    rows = transactions_raw(spark, wh).groupBy("source_file").count().collect()
    assert {r["source_file"]: r["count"] for r in rows} == want
    assert result.skipped_files == []
    assert sorted(os.path.relpath(p.removeprefix("file:"), tmp_path / "i[n]") for p in result.failed_files) == sorted(hidden)
    again = ingest(spark, str(tmp_path / "i[n]"), wh)
    assert again.processed_files == [] and len(again.skipped_files) == len(want)
    assert transactions_raw(spark, wh).count() == sum(want.values())


def test_columns_go_by_the_files_own_header(spark, tmp_path):
    wh = str(tmp_path / "wh")
    lines = [line.split(",") for line in csv_text([trip(id="r1")]).splitlines()]
    (tmp_path / "in").mkdir()
    turned = "\n".join(",".join(reversed(line)) for line in lines) + "\n"
    (tmp_path / "in/turned.csv").write_text("\ufeff" + turned)
    fewer = "\r\n".join(",".join(line[:3]) for line in lines).replace("r1", "r2") + "\r\n"
    (tmp_path / "in/fewer.csv").write_bytes(fewer.encode())
    quoted = csv_text([trip(id='"q,x,y,z"', trip_duration=None)]).rstrip("\n").removesuffix(",")
    (tmp_path / "in/quoted.csv").write_text(quoted + "\n")
    assert ingest(spark, str(tmp_path / "in"), wh).failed_files == {}
    rows = {r.id: (r.vendor_id, r.store_and_fwd_flag, r.trip_duration) for r in transactions_raw(spark, wh).collect()}
    assert rows == {"r1": ("1", "N", "455"), "r2": ("1", None, None), "q,x,y,z": ("1", "N", None)}


def test_missing_texts_become_null(spark, tmp_path):
    write_csv(
        tmp_path / "in/a.csv",
        [
            trip(id="ok", store_and_fwd_flag=None),
            trip(id="lat", pickup_latitude="NaN"),
            trip(id="NA"),
            trip(id="inf", pickup_latitude="Infinity"),
        ],
    )
    run(spark, tmp_path)
    wh = str(tmp_path / "wh")
    kept = {r.id for r in silver_table(spark, wh, B).read().collect()}
    assert kept == {"ok", "inf"}
    errors = {r.id: r.validation_error for r in rejects(spark, wh).collect()}
    assert errors == {"lat": "bad coordinates; ", None: "missing id; "}


def test_raw_batch_prunes_partitions(spark, tmp_path):
    for number in range(3):
        write_csv(tmp_path / f"in/{number}.csv", many(12, start=100 * number))
        run(spark, tmp_path)
    batch = raw_batch(spark, str(tmp_path / "wh"), 4)
    assert [r.id for r in batch.orderBy("id").collect()] == ["m110", "m111"]
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_id" in plan or "PartitionFilters: [load_id" in plan
    assert "EqualTo(batch_no,4)" in plan
    assert len(batch.columns) == 14


def test_star_schema(spark, tmp_path):
    write_csv(
        tmp_path / "in/a.csv",
        [
            trip(id="a", vendor_id="2"),
            trip(id="b", pickup_datetime="2016-02-29 00:00:00"),
            trip(id="c", pickup_datetime="2016-02-29 23:59:59"),
        ],
    )
    run(spark, tmp_path)
    wh = str(tmp_path / "wh")
    assert sorted(r.vendor_id for r in dim_vendor(spark, wh).read().collect()) == [1, 2]
    dates = dim_date(spark, wh).read()
    assert sorted((str(r.date_id), r.year, r.month, r.day) for r in dates.collect()) == [
        ("2016-02-29", 2016, 2, 29),
        ("2016-03-14", 2016, 3, 14),
    ]
    report = v_trip_report(fact_trips(spark, wh, B).read(), dates)
    assert len(report.columns) == 14
    assert {(r.id, r.month) for r in report.collect()} == {("a", 3), ("b", 2), ("c", 2)}


def test_gold_reads_only_what_silver_has_changed(spark, tmp_path, monkeypatch):
    write_csv(tmp_path / "in/a.csv", many(200))
    paths = str(tmp_path / "in"), str(tmp_path / "wh")
    run_pipeline(spark, *paths, chunk_size=1000, buckets=16)
    write_csv(tmp_path / "in/b.csv", [trip(id="m7", passenger_count="4"), trip(id="fresh")])
    opened = []
    read = KeyedTable.read

    def spied(table, after=0):
        rows = read(table, after)
        if "silver" in table.path:
            opened.append(len(rows.inputFiles()))
        return rows

    monkeypatch.setattr(KeyedTable, "read", spied)
    run_pipeline(spark, *paths, chunk_size=1000, buckets=16)
    assert len(opened) == 1 and 1 <= opened[0] <= 2
    monkeypatch.undo()
    facts = fact_trips(spark, str(tmp_path / "wh"), 16).read()
    assert facts.count() == 201 and facts.where("id = 'm7'").first().passenger_count == 4


def test_many_loads_are_read_by_their_directories(spark, tmp_path):
    wh = str(tmp_path / "wh")
    for n in range(3):
        write_csv(tmp_path / f"in/f{n}.csv", many(2, start=10 * n))
        ingest(spark, str(tmp_path / "in"), wh)
    loads = [r.load_id for r in load_log(spark, wh).collect()]
    stray = tmp_path / "wh/raw/transactions_raw/load_id=dead"
    transactions_raw(spark, wh).drop("load_id").write.parquet(str(stray))
    assert transactions_raw(spark, wh).count() == 6
    one = transactions_raw(spark, wh, loads[:1] * 1001)
    assert all(loads[0] in f for f in one.inputFiles()) and "load_id" in one.columns


def test_arrivals_stream_is_repeatable(spark, tmp_path):
    write_csv(tmp_path / "in/a.csv", many(5))
    wh, seen = str(tmp_path / "wh"), []

    def go():
        process_arrivals(
            spark, str(tmp_path / "in"), wh, str(tmp_path / "cp"), 10, B, after_load=seen.append
        ).awaitTermination(120)

    go()
    go()
    assert seen == [0] and fact_trips(spark, wh, B).read().count() == 5
    write_csv(tmp_path / "in/copy.csv", many(5))
    go()
    assert seen == [0, 1]
    assert transactions_raw(spark, wh).count() == 10
    assert fact_trips(spark, wh, B).read().count() == 5
