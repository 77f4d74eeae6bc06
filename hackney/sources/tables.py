"""Keyed tables kept as Parquet: an upsert rewrites only the files it hits."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hackney.operators.key_filter import blocks_for, build_filters, may_hold
from hackney.operators.latest import matched, merge_by_key
from hackney.sources.storage import (
    append_small,
    child_directories,
    child_files,
    control_rows,
    delete_path,
    literal,
    no_rows,
    read_or_empty,
)

# The part of a key that a file's range keeps.
KEY_CHARS = 64
# One row for each file a version adds or takes out.
FILES = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("live", T.BooleanType()),
        # The least and greatest key as texts, each cut at KEY_CHARS; NULL if not known.
        T.StructField("low", T.StringType()),
        T.StructField("high", T.StringType()),
        # Blocks of the filter of its keys; 0 if it has none, NULL in logs older than filters.
        T.StructField("blocks", T.IntegerType()),
        T.StructField("committed_at", T.TimestampType()),
    ]
)


class KeyedTable:
    """A table with at most one row per key.

    Rows lie in files below ``buckets`` directories by a hash of the key, and the log of
    files has the range of keys in each. A merge looks for its keys in the key
    column of those files of the touched buckets whose range meets that of its keys,
    writes the rows of the files that hold some of them, and the new rows, to new files,
    and then appends one small file to the log that says which files came and went.
    Keys that are new leave all stored files alone, and keys past those stored open
    none. A job that dies before that append leaves the table as it was.

    Where keys come in no order, ranges tell nothing. With ``key_filters`` each new file
    gets a Bloom filter of its keys, three bytes a key, and a merge opens only files
    whose filter one of its keys passes. Files with and without filters may be mixed.

    New rows are written by one task per bucket, or ``parts`` tasks for each. Merges
    leave small files; ``compact`` joins them. One writer at a time.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: list[str],
        buckets: int = 64,
        parts: int = 1,
        key_filters: bool = False,
    ):
        self.spark = spark
        self.path = path
        self.schema = schema
        self.keys = keys
        self.buckets = buckets
        self.parts = parts
        self.key_filters = key_filters

    def _hash(self, modulus: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *self.keys), F.lit(modulus)).cast("int")

    def _log(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/files", FILES)

    def _live(self, any_layout: bool = False) -> list:
        """The files that hold the table, with version and bucket.

        The list is as long as the one Spark's own file index holds for a read.
        """
        live = (
            self._log()
            .groupBy("file", "bucket", "buckets")
            .agg(
                F.min("version").alias("version"),
                F.min("live").alias("live"),
                F.max("low").alias("low"),
                F.max("high").alias("high"),
                F.max("blocks").alias("blocks"),
            )
            .where("live")
            .collect()
        )
        for row in live:
            if row.buckets != self.buckets and not any_layout:
                raise ValueError(
                    f"{self.path} has {row.buckets} buckets, not {self.buckets}"
                )
        return live

    def _read(self, files: Iterable, schema: T.StructType | None = None) -> DataFrame:
        paths = sorted(literal(f"{self.path}/data/{row.file}") for row in files)
        if not paths:
            return no_rows(self.spark, schema or self.schema)
        return self.spark.read.schema(schema or self.schema).parquet(*paths)

    def read(self, after: int = 0) -> DataFrame:
        """The rows; of files written after version ``after`` only, if given."""
        return self._read(row for row in self._live() if row.version > after)

    def version(self) -> int:
        """The newest version; 0 for a table never written."""
        return self._log().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v

    def drop_replaced(self, keep: int = 2) -> int:
        """Delete files that none of the newest ``keep`` versions holds; how many.

        A reader that started before the last ``keep - 1`` merges may still be
        reading what this deletes. Files of jobs that died go as well.
        """
        if keep < 1:
            raise ValueError(f"keep must be at least 1, not {keep}")
        log = self._log().select("version", "file", "live").collect()
        versions = sorted({row.version for row in log})
        if not versions:
            return 0
        oldest = versions[-keep:][0]
        gone = {row.file for row in log if not row.live and row.version <= oldest}
        known = {row.file for row in log}
        dropped = 0
        for version in child_directories(self.spark, f"{self.path}/data"):
            # A later version is one a merge is writing now.
            if int(version.rpartition("=")[2]) > versions[-1]:
                continue
            for bucket in child_directories(self.spark, version):
                for path in child_files(self.spark, bucket):
                    name = _relative(path)
                    if name in gone or name not in known:
                        delete_path(self.spark, path)
                        dropped += 1
        kept = {row.file.partition("/")[0] for row in log if row.file not in gone}
        for path in child_directories(self.spark, f"{self.path}/filters"):
            name = path.rpartition("/")[2]
            if name not in kept and int(name.rpartition("=")[2]) <= versions[-1]:
                delete_path(self.spark, path)
        return dropped

    def merge(self, incoming: DataFrame, keep: str = "incoming") -> None:
        """Upsert ``incoming``, which holds a key at most once.

        On a shared key ``keep="incoming"`` replaces the stored row and
        ``keep="stored"`` leaves it.
        """
        if keep not in ("incoming", "stored"):
            raise ValueError(f"keep must be 'incoming' or 'stored', not {keep!r}")
        version = self.version() + 1
        rows = incoming.select(*self.schema.names).withColumn(
            "bucket", self._hash(self.buckets, 0)
        )
        # Written out once: it decides which buckets are touched, and the merge
        # then reads rows whose size is known and whose lineage is short.
        stage = f"{self.path}/stage/version={version}"
        rows.write.mode("overwrite").parquet(stage)
        staged = self.spark.read.schema(rows.schema).parquet(stage)
        low, high = self._range()
        touched = {
            r.bucket: r for r in staged.groupBy("bucket").agg(low, high).collect()
        }
        if touched:
            self._merge(staged, touched, version, keep)
        delete_path(self.spark, stage)

    def _range(self) -> list[Column]:
        """Aggregates of the least and greatest key, as texts; NULL comes as empty."""
        key = F.substring(F.coalesce(F.col(self.keys[0]).cast("string"), F.lit("")), 1, KEY_CHARS)
        return [F.min(key).alias("low"), F.max(key).alias("high")]

    def _merge(self, staged: DataFrame, touched: dict, version: int, keep: str) -> None:
        near = {
            row.file: row
            for row in self._live()
            if row.bucket in touched and _meet(row, touched[row.bucket])
        }
        near = self._likely(staged, near)
        new = staged.drop("bucket")
        if not near:
            self._write(new, version, [])
            return
        # Only the key columns of those files are read here.
        key_schema = T.StructType([f for f in self.schema.fields if f.name in self.keys])
        stored = self._read(near.values(), key_schema)
        if keep == "stored":
            fresh = matched(new, stored, self.keys, "left_anti")
            self._write(fresh, version, [])
            return
        at = stored.select(*self.keys, F.col("_metadata.file_path").alias("_file"))
        found = matched(at, new, self.keys, "left_semi").select("_file").distinct().collect()
        hit = [near[_relative(row["_file"])] for row in found]
        self._write(merge_by_key(self._read(hit), new, self.keys), version, hit)

    def _likely(self, staged: DataFrame, near: dict) -> dict:
        """Those of the files ``near`` whose filters some staged key passes, or that have none."""
        with_filter = [row for row in near.values() if row.blocks]
        if not with_filter:
            return near
        rows = [(row.file, row.bucket, row.blocks) for row in with_filter]
        files = control_rows(self.spark, rows, ["file", "bucket", "blocks"])
        paths = {literal(f"{self.path}/filters/version={row.version}") for row in with_filter}
        filters = self.spark.read.parquet(*sorted(paths))
        found = may_hold(staged, files, filters, self.keys, "bucket").collect()
        passed = {row.file for row in found}
        return {name: row for name, row in near.items() if not row.blocks or name in passed}

    def _write(self, rows: DataFrame, version: int, replaced: list) -> None:
        """New files of ``rows``, then the log entry that also ends ``replaced``."""
        # Each bucket has ``parts`` tasks of its own; those of others have no rows.
        bucket = self._hash(self.buckets, 0)
        task = (bucket * self.parts + self._hash(self.parts, 1)).cast("int")
        # Mode overwrite: a version left by a job that died is written anew.
        data = f"{self.path}/data/version={version}"
        rows.withColumn("bucket", bucket).repartitionById(
            self.buckets * self.parts, task
        ).write.mode("overwrite").partitionBy("bucket").parquet(data)
        names = {
            _relative(path): int(bucket.rpartition("=")[2])
            for bucket in child_directories(self.spark, data)
            for path in child_files(self.spark, bucket)
        }
        ranges = self._ranges(names)
        none = (None, None, 0)
        added = [
            (version, bucket, self.buckets, name, True, *ranges.get(name, none))
            for name, bucket in names.items()
        ]
        if self.key_filters:
            self._write_filters(version, {name: found[2] for name, found in ranges.items()})
        ended = [(version, r.bucket, r.buckets, r.file, False, *none) for r in replaced]
        if not added and not ended:
            return
        entries = control_rows(self.spark, added + ended, FILES.names[:-1]).withColumn(
            "committed_at", F.current_timestamp()
        )
        append_small(
            entries.select(*[F.col(f.name).cast(f.dataType) for f in FILES.fields]),
            f"{self.path}/files",
        )

    def _keys_of(self, names: Iterable[str], keys: list[str]) -> DataFrame:
        """Key columns of some files just written, with the name of each row's file."""
        schema = T.StructType([f for f in self.schema.fields if f.name in keys])
        paths = [literal(f"{self.path}/data/{name}") for name in names]
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.select(*keys, F.substring_index("_metadata.file_path", "/", -3).alias("file"))

    def _ranges(self, names: Iterable[str]) -> dict[str, tuple[str, str, int]]:
        """The range of keys in each of some files, from their first key column.

        With ``key_filters`` also the blocks that the filter of the file is to have.
        """
        if not names:
            return {}
        rows = self._keys_of(names, self.keys[:1]).groupBy("file")
        return {
            row.file: (row.low, row.high, blocks_for(row.rows) if self.key_filters else 0)
            for row in rows.agg(*self._range(), F.count(F.lit(1)).alias("rows")).collect()
        }

    def _write_filters(self, version: int, blocks: dict[str, int]) -> None:
        if not blocks:
            return
        sizes = control_rows(self.spark, list(blocks.items()), ["file", "blocks"])
        rows = self._keys_of(blocks, self.keys).join(sizes, "file")
        filters = build_filters(rows, self.keys)
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/version={version}")

    def compact(self) -> None:
        """Rewrite the whole table into one file per bucket and part.

        A table made with other ``buckets`` takes this object's number on the way.
        """
        live = self._live(any_layout=True)
        if live:
            self._write(self._read(live), self.version() + 1, live)


def _meet(stored, wanted) -> bool:
    """Can two ranges of keys share one? Yes where one is not known.

    Texts compare by code points, which is the order of their UTF-8 bytes.
    """
    if stored.low is None or stored.high is None:
        return True
    return stored.low <= wanted.high and wanted.low <= stored.high


def _relative(path: str) -> str:
    """``version=<n>/bucket=<n>/<name>`` of a data file, however the path is spelt."""
    return "/".join(path.split("/")[-3:])
