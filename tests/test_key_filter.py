from pyspark.sql import functions as F
from pyspark.sql import types as T

from hackney.operators.key_filter import blocks_for, build_filters, may_hold
from hackney.plans.gold import fact_trips
from hackney.plans.pipeline import run_pipeline
from hackney.sources.tables import KeyedTable
from trip_files import many, write_csv

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])


def test_no_held_key_is_missed_and_few_others_pass(spark):
    size = 5000
    blocks = blocks_for(size)
    assert blocks == 4 and blocks_for(0) == 1
    held = spark.range(size).select(
        F.when(F.col("id") > 0, F.format_string("id%d", "id")).alias("k"), F.lit(blocks).alias("blocks")
    )
    filters = build_filters(held.withColumn("file", F.lit("f")), ["k"])
    # Each key stands as a file of its own, whose filter is that of the one file.
    keys = held.select("k").union(spark.range(20_000).selectExpr("'no' || id"))
    rows = keys.select("k", F.coalesce("k", F.lit("null")).alias("b"))
    files = rows.select(F.col("b"), F.col("b").alias("file"), F.lit(blocks).alias("blocks"))
    own = files.select("file").crossJoin(filters.select("block", "bits"))
    found = {r.file for r in may_hold(rows, files, own, ["k"], "b").collect()}
    assert found >= {f"id{n}" for n in range(1, size)} | {"null"}
    assert len(found) - size < 40


def rows_of(spark, first, last, value):
    """Keys without any order."""
    return spark.range(first, last).select(
        F.md5(F.col("id").cast("string")).alias("k"), F.lit(value).alias("v")
    )


def test_new_unordered_keys_open_no_stored_file(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4, key_filters=True)
    table.merge(rows_of(spark, 0, 3000, "a"))
    opened, read = [], table._read

    def noted(files, schema=None):
        files = list(files)
        opened.append(len(files))
        return read(files, schema)

    monkeypatch.setattr(table, "_read", noted)
    table.merge(rows_of(spark, 3000, 3010, "b"))
    assert opened == []
    table.merge(rows_of(spark, 2999, 3000, "c"))  # one file holds it: its keys, then its rows
    assert opened == [1, 1]
    monkeypatch.undo()
    got = {r.k: r.v for r in table.read().collect()}
    parts = rows_of(spark, 0, 2999, "a"), rows_of(spark, 2999, 3000, "c"), rows_of(spark, 3000, 3010, "b")
    want = {r.k: r.v for part in parts for r in part.collect()}
    assert got == want and table.read().count() == 3010
    # A table without filters reads the same files, and its own files are looked into.
    plain = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4)
    plain.merge(rows_of(spark, 3020, 3021, "d"))
    table.merge(rows_of(spark, 3020, 3022, "e"), keep="stored")
    got = {r.v for r in table.read().join(rows_of(spark, 3020, 3021, "").select("k"), "k").collect()}
    assert got == {"d"} and table.read().count() == 3012
    table.compact()
    table.drop_replaced(keep=1)
    assert len(list((tmp_path / "t/filters").iterdir())) == 1
    table.merge(rows_of(spark, 5, 6, "f"))
    assert table.read().where("v = 'f'").count() == 1 and table.read().count() == 3012


def test_a_run_with_key_filters(spark, tmp_path):
    wh = str(tmp_path / "wh")
    for name, rows in (("a", many(20)), ("b", many(10, start=15, trip_duration="77"))):
        write_csv(tmp_path / f"in/{name}.csv", rows)
        run_pipeline(spark, str(tmp_path / "in"), wh, buckets=2, key_filters=True)
    got = {r.id: r.trip_duration for r in fact_trips(spark, wh, 2).read().collect()}
    assert got == {f"m{n}": 59 if n < 15 else 77 for n in range(25)}
    for table in ("silver/transactions_clean", "gold/fact_trips"):
        assert len(list((tmp_path / "wh" / table / "filters").glob("version=*"))) == 2
