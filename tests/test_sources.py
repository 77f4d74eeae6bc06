import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from hackney.schemas import DIM_DATE, FACT_TRIPS
from hackney.sources.files import _hash_lines, discover_csv, fingerprint, single_file
from hackney.sources.jdbc import batch_query
from hackney.sources.storage import control_rows
from hackney.sources.tables import KeyedTable


def sha(data):
    return hashlib.sha256(data).hexdigest()


def hashes(spark, files):
    return {r.file_name: r.file_hash for r in fingerprint(spark, files).collect()}


MARK = b"\xef\xbb\xbf"
CONTENTS = {
    "a.csv": b"x",
    "b b.CSV": bytes(range(256)) * 40,
    "sub/d.csv": b"y" * 5000,
    "ended.csv": b"x\n",
    "blank.csv": b"\n",
    "blanks.csv": b"\n\nx\n\n\n",
    "mark.csv": MARK,
    "mark x.csv": MARK + b"x",
    "mark end.csv": MARK + b"x\ny\n",
    "mark blank.csv": MARK + b"\n",
    "marks.csv": MARK + MARK + b"\n" + MARK,
    "dos.csv": b"a,b\r\n1,2\r\n",
    "mac.csv": b"a,b\r1,2\r",
    "sub/é%20.csv": "é,\u2028,\0\n".encode("utf-16"),
}


def test_fingerprints(spark, tmp_path):
    data = CONTENTS | {"long.csv": b"\n".join(b"%d" % n for n in range(60_000))}
    for name, content in data.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (tmp_path / "in/e.txt").write_text("no csv")
    (tmp_path / "in/empty.csv").write_text("")
    files = discover_csv(spark, str(tmp_path / "in"))
    want = {name.split("/")[-1]: sha(content) for name, content in data.items()}
    # Whatever the session's splits are.
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        assert hashes(spark, files) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    headers = {r.file_name: r.header for r in fingerprint(spark, files).collect()}
    assert headers["dos.csv"] == "a,b\r" and headers["long.csv"] == "0" and headers["mark x.csv"] == "x"
    # A listed file that is gone is an error.
    listed = files.collect()
    (tmp_path / "in/a.csv").unlink()
    with pytest.raises(Exception, match="not read|PATH_NOT_FOUND|not exist"):
        fingerprint(spark, control_rows(spark, listed, files.columns)).collect()
    one = single_file(spark, str(tmp_path / "in/e.txt"))
    assert [r.file_name for r in one.collect()] == ["e.txt"]


def test_a_file_that_comes_in_many_batches_is_hashed_as_one():
    content = MARK + b"".join(b"line %d\n" % n for n in range(50)) + b"last"
    lines = content[3:].split(b"\n")
    rows = [("p", len(content), line) for line in lines] + [("q", 2, b"z"), ("r", 1, b"w")]

    def batches(size):
        for start in range(0, len(rows), size):
            part = zip(*rows[start : start + size], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(part, (pa.string(), pa.int64(), pa.binary()), strict=True)],
                ["file_path", "length", "line"],
            )

    want = [("p", sha(content), "line 0"), ("q", sha(b"z\n"), "z"), ("r", sha(b"w"), "w")]
    for size in (1, 3, 7, 1000):
        got = [tuple(r.values()) for b in _hash_lines(batches(size)) for r in b.to_pylist()]
        assert got == want
    rows[-1] = ("r", 9, b"w")
    with pytest.raises(OSError, match="9 bytes listed"):
        list(_hash_lines(batches(4)))


def test_keyed_table_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    table = KeyedTable(spark, path, schema, ["k"], buckets=8, parts=2)
    assert table.read().count() == 0

    def rows(pairs):
        return spark.createDataFrame(pairs, schema)

    table.merge(rows([(n, "old") for n in range(100)]))
    table.merge(rows([(5, "new"), (100, "new")]))
    table.merge(rows([(6, "ignored"), (101, "kept")]), keep="stored")
    table.merge(rows([]))
    got = dict(map(tuple, table.read().collect()))
    assert got == {n: "old" for n in range(100)} | {5: "new", 100: "new", 101: "kept"}
    second = [p.name for p in (tmp_path / "t/data/version=2").glob("bucket=*")]
    assert 1 <= len(second) <= 2
    assert not list((tmp_path / "t/stage").glob("*"))
    assert table.drop_replaced(keep=3) == 0
    assert table.drop_replaced(keep=1) == 1
    assert table.drop_replaced(keep=1) == 0
    assert dict(map(tuple, table.read().collect())) == got
    with pytest.raises(ValueError, match="keep"):
        table.drop_replaced(keep=0)
    with pytest.raises(ValueError, match="8 buckets"):
        KeyedTable(spark, path, schema, ["k"], buckets=4).read()


def test_new_keys_rewrite_no_stored_file(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=4)
    table.merge(spark.range(20_000).selectExpr("CAST(id AS INT) AS k", "'x' AS v"))
    before = set(table.read().inputFiles())
    table.merge(spark.range(20_000, 20_040).selectExpr("CAST(id AS INT) AS k", "'y' AS v"))
    after = set(table.read().inputFiles())
    assert before < after and table.read().count() == 20_040
    new = table.read(after=1)
    assert new.count() == 40 and set(new.inputFiles()) == after - before
    table.compact()
    assert len(table.read().inputFiles()) == 4 and table.read().count() == 20_040
    other = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=6)
    other.compact()
    assert len(other.read().inputFiles()) == 6 and other.read().count() == 20_040
    assert other.drop_replaced(keep=1) == 12


def test_keys_past_those_stored_open_no_stored_file(spark, tmp_path, monkeypatch):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=4)

    def rows(first, last, value):
        return spark.range(first, last).selectExpr("printf('id%05d', id) AS k", f"'{value}' AS v")

    table.merge(rows(0, 2000, "a"))
    opened = []
    read = KeyedTable._read

    def noted(self, files, *schema):
        files = list(files)
        opened.append(len(files))
        return read(self, files, *schema)

    with monkeypatch.context() as patch:
        patch.setattr(KeyedTable, "_read", noted)
        table.merge(rows(2000, 3000, "b"))
        table.merge(rows(3000, 3500, "c"), keep="stored")
        assert opened == []
        # Of twelve files the four of the second merge are looked into, and rewritten.
        table.merge(rows(2400, 2500, "d"))
        assert opened == [4, 4]
    got = {r.v: r["count"] for r in table.read().groupBy("v").count().collect()}
    assert got == {"a": 2000, "b": 900, "c": 500, "d": 100}


def test_key_ranges_of_odd_keys(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=1)
    long = "x" * 100
    keys = [None, "", "a", "é", "\U0001f600", "\uffff", long, long + "y", "10", "9"]
    want = {}
    for turn, some in enumerate([keys[:3], keys[3:7], keys[7:], [long + "z"], keys, [keys[6]], [keys[4]]]):
        table.merge(spark.createDataFrame([(k, turn) for k in some], schema))
        want |= dict.fromkeys(some, turn)
        assert dict(map(tuple, table.read().collect())) == want
        assert table.read().count() == len(want)
    # A log without ranges, as written before there were any.
    log = spark.read.parquet(f"{tmp_path}/t/files").drop("low", "high").collect()
    old = KeyedTable(spark, str(tmp_path / "old"), schema, ["k"], buckets=1)
    spark.createDataFrame(log).selectExpr(
        "CAST(version AS INT)", "CAST(bucket AS INT)", "CAST(buckets AS INT)", "file", "live", "committed_at"
    ).write.parquet(f"{tmp_path}/old/files")
    (tmp_path / "t/data").rename(tmp_path / "old/data")
    old.merge(spark.createDataFrame([("a", 70), ("zz", 71)], schema))
    assert dict(map(tuple, old.read().collect())) == want | {"a": 70, "zz": 71}


def test_random_merges_equal_a_dictionary(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=3, parts=2)
    rng, want = random.Random(4), {}
    for turn in range(6):
        keys = rng.sample([None, *range(60)], rng.randint(0, 25))
        rows = {k: f"{turn}-{k}" for k in keys}
        keep = rng.choice(["incoming", "stored"])
        table.merge(spark.createDataFrame(list(rows.items()), schema), keep)
        want = want | rows if keep == "incoming" else rows | want
        assert dict(map(tuple, table.read().collect())) == want
        assert table.read().count() == len(want)
        if turn == 3:
            table.compact()
            table.drop_replaced(keep=1)


def test_every_bucket_has_tasks_of_its_own(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=64, parts=2)
    table.merge(spark.range(5000).selectExpr("CAST(id AS INT) AS k", "'x' AS v"))
    files = [p.name for p in (tmp_path / "t/data").glob("version=1/bucket=*/*.parquet")]
    # A task writes a file per bucket it holds: 128 tasks, one bucket each.
    assert len(files) == 128 == len({name.split("-")[1] for name in files})


def test_a_read_after_a_version_opens_only_later_files(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=8)
    table.merge(spark.range(100).selectExpr("CAST(id AS INT) AS k", "'x' AS v"))
    assert table.version() == 1
    table.merge(spark.createDataFrame([(5, "new")], schema))
    later = table.read(after=1)
    assert {f.split("/version=")[1][0] for f in later.inputFiles()} == {"2"}
    assert later.where("v = 'new'").count() == 1 and later.count() < 100
    assert table.read(after=2).count() == 0 and table.read().count() == 100


def test_single_bucket_table_without_rows(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "d"), DIM_DATE, ["date_id"], buckets=1)
    empty = spark.createDataFrame([], DIM_DATE)
    table.merge(empty)
    assert table.read().count() == 0
    table.merge(spark.sql("SELECT DATE'2024-02-29' AS date_id, 2024 AS year, 2 AS month, 29 AS day"))
    table.merge(empty)
    assert table.read().count() == 1
    assert table.read().columns == DIM_DATE.names


def test_a_merge_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "f"), FACT_TRIPS, ["id"], buckets=2)

    def rows(*ids):
        return spark.createDataFrame([(i,) for i in ids], "id string").selectExpr(
            "id",
            *[
                f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}"
                for f in FACT_TRIPS.fields
                if f.name != "id"
            ],
        )

    table.merge(rows("a", "b"))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("hackney.sources.tables.append_small", fail)
        with pytest.raises(OSError):
            table.merge(rows("b", "c", "d"))
    assert sorted(r.id for r in table.read().collect()) == ["a", "b"]
    table.merge(rows("c"))
    assert sorted(r.id for r in table.read().collect()) == ["a", "b", "c"]


def test_batch_query_is_pruned_and_filtered():
    text = batch_query("raw.transactions_raw", [3, 5])
    assert text.startswith("(SELECT batch_no, source_file, file_hash, id, vendor_id,")
    assert text.endswith("FROM raw.transactions_raw WHERE batch_no IN (3, 5)) AS raw_batch")
