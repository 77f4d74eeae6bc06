"""Raw layer: new CSV files become an append-only table of numbered batches.

A load writes its rows below ``load_id=<id>`` and then appends one file to the
load log. Only loads in the log are visible, so a job that dies half way leaves
nothing behind that a later stage could read twice.
"""

import time
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hackney.operators.incremental import first_delivery, new_files
from hackney.operators.numbering import batch_of, check_chunk_size, rows_before
from hackney.schemas import LOAD_LOG, RAW, TRIP_COLUMNS
from hackney.sources.files import (
    FILE,
    FILE_STATE,
    base_name_of,
    discover_csv,
    fingerprint,
    known_states,
    single_file,
)
from hackney.sources.storage import (
    append_small,
    control_rows,
    delete_path,
    hidden_files,
    literal,
    no_rows,
    read_or_empty,
)
from hackney.sources.trip_csv import HeaderError, header_columns, read_trip_csv, split_session

LOAD_MODES = ("incremental", "full")
HIDDEN = "Spark reads no file whose name or folder begins with _ or ."
DEFAULT_CHUNK_SIZE = 100_000
# A file changed this shortly before it was listed could change again within the same
# tick of its file system's clock, so its state is not trusted by later runs.
SETTLED_SECONDS = 10
# Splits of a load, half a kilobyte each, whose offsets are broadcast.
BROADCAST_SPLITS = 500_000

RAW_WITH_LOAD = T.StructType([*RAW.fields, T.StructField("load_id", T.StringType())])


@dataclass(frozen=True)
class IngestResult:
    load_mode: str
    should_continue: bool
    processed_files: list[str] = field(default_factory=list)
    skipped_files: list[str] = field(default_factory=list)
    failed_files: dict[str, str] = field(default_factory=dict)


def check_load_mode(load_mode: str) -> None:
    if load_mode not in LOAD_MODES:
        raise ValueError(f"load_mode must be one of {LOAD_MODES}, not {load_mode!r}")


def load_log(spark: SparkSession, warehouse: str) -> DataFrame:
    """One row per loaded file and load; the commit record of the raw layer."""
    return read_or_empty(spark, f"{warehouse}/raw/load_log", LOAD_LOG)


def ingestion_log(spark: SparkSession, warehouse: str) -> DataFrame:
    """Known files, each (name, content) once with its first load time."""
    return (
        load_log(spark, warehouse)
        .groupBy("file_name", "file_hash")
        .agg(F.min("loaded_at").alias("loaded_at"))
    )


def file_states(spark: SparkSession, warehouse: str) -> DataFrame:
    """Path, length, time of change, hash and header of every file state read so far."""
    return read_or_empty(spark, f"{warehouse}/raw/file_states", FILE_STATE)


def committed_batches(spark: SparkSession, warehouse: str) -> DataFrame:
    """(load_id, first_batch, last_batch): a range for each loaded file, from the log alone."""
    return (
        load_log(spark, warehouse)
        .where("row_count > 0")
        .select("load_id", "first_batch", "last_batch")
    )


def transactions_raw(
    spark: SparkSession, warehouse: str, loads: list[str] | None = None
) -> DataFrame:
    """Committed raw rows; of given ``loads`` only, each read by its directory."""
    if loads is None:
        log = load_log(spark, warehouse).select("load_id").distinct()
        loads = [row.load_id for row in log.collect()]
    if not loads:
        return no_rows(spark, RAW_WITH_LOAD)
    root = f"{warehouse}/raw/transactions_raw"
    paths = [literal(f"{root}/load_id={load}") for load in loads]
    return spark.read.schema(RAW_WITH_LOAD).option("basePath", root).parquet(*paths)


def raw_batch(spark: SparkSession, warehouse: str, batch_no: int) -> DataFrame:
    """The rows of one batch: its load by partition, its rows by pushed filter."""
    holds = (F.col("first_batch") <= batch_no) & (F.col("last_batch") >= batch_no)
    log = load_log(spark, warehouse).where((F.col("row_count") > 0) & holds)
    loads = [r.load_id for r in log.select("load_id").distinct().collect()]
    return (
        transactions_raw(spark, warehouse, loads)
        .where(F.col("load_id").isin(*loads) & (F.col("batch_no") == batch_no))
        .select("batch_no", "source_file", "file_hash", *TRIP_COLUMNS)
    )


def ingest(
    spark: SparkSession,
    source: str | None,
    warehouse: str,
    load_mode: str = "incremental",
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    file: str | None = None,
    multi_line: bool = False,
    recheck: bool = False,
) -> IngestResult:
    """Load the CSV files below ``source`` (or the one ``file``) that are new.

    ``full`` loads every selected file again; the raw layer is a history. A file that
    cannot be loaded is named in ``failed_files`` with the reason and tried again
    by the next run; the others are loaded. Content is read only of files whose path,
    length and time of change were not read before, or of all with ``recheck``.
    """
    check_load_mode(load_mode)
    if file:
        if base_name_of(file).startswith(("_", ".")):
            raise ValueError(f"{file}: {HIDDEN}")
        files = single_file(spark, file)
        return ingest_files(
            spark, files, warehouse, load_mode, chunk_size, multi_line, recheck
        )
    unreadable = dict.fromkeys(hidden_files(spark, source, ".csv"), HIDDEN)
    files = discover_csv(spark, source)
    result = ingest_files(
        spark, files, warehouse, load_mode, chunk_size, multi_line, recheck
    )
    return replace(result, failed_files=unreadable | result.failed_files)


def ingest_files(
    spark: SparkSession,
    files: DataFrame,
    warehouse: str,
    load_mode: str = "incremental",
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    multi_line: bool = False,
    recheck: bool = False,
) -> IngestResult:
    """``ingest`` for a given listing (path, file_path, file_name, length, modified)."""
    check_load_mode(load_mode)
    check_chunk_size(chunk_size)

    now = time.time()
    # File names only; Spark's own file index holds the same list on the driver.
    listing = files.orderBy("path").collect()
    if not listing:
        return IngestResult(load_mode, False)
    hashed = _hashed(spark, listing, warehouse, now, recheck)
    if load_mode == "full":
        chosen = hashed
    else:
        chosen = new_files(first_delivery(hashed), ingestion_log(spark, warehouse))
    fresh = sorted(chosen.collect(), key=lambda row: row.path)
    # Every listed file has its hash, so what is not new is in the ledger already.
    new = {row.path for row in fresh}
    skipped = [row.path for row in listing if row.path not in new]
    failed, layouts = {}, {}
    for row in fresh:
        try:
            layouts.setdefault(tuple(header_columns(row.header)), []).append(row.path)
        except HeaderError as error:
            failed[row.path] = str(error)
    fresh = [row for row in fresh if row.path not in failed]
    if fresh:
        failed |= _load(spark, fresh, layouts, warehouse, chunk_size, multi_line)
    processed = [row.path for row in fresh if row.path not in failed]
    should_continue = bool(processed) or load_mode == "full"
    return IngestResult(load_mode, should_continue, processed, skipped, failed)


def _hashed(spark, listing, warehouse, now, recheck) -> DataFrame:
    """The listing with hashes and headers; only content of new file states is read."""
    names = [*FILE.names, "file_hash", "header"]
    listed = control_rows(spark, listing, FILE.names)
    states = file_states(spark, warehouse)
    known = known_states(listed, states.limit(0) if recheck else states).collect()
    found = [row for row in known if row.file_hash]
    unread = [row for row in known if not row.file_hash]
    if unread:
        read = fingerprint(spark, control_rows(spark, unread, FILE.names)).collect()
        if len(read) != len(unread):
            raise OSError("files changed while they were listed")
        found += read
        settled = (now - SETTLED_SECONDS) * 1e6
        state = [
            (row.path, row.length, row.modified, row.file_hash, row.header, row.modified < settled)
            for row in read
        ]
        append_small(
            control_rows(spark, state, FILE_STATE.names), f"{warehouse}/raw/file_states"
        )
    return control_rows(spark, found, names)


def split_offsets(splits: DataFrame, per_file: DataFrame) -> DataFrame:
    """One row per split: its file's name and hash, and the rows and batches before it.

    Up to ``BROADCAST_SPLITS`` splits are handed to every executor, so no row of the load
    is shuffled to find its offset; beyond, Catalyst chooses the join.
    """
    offsets = splits.join(per_file, "file_no").select(
        F.col("file_path").alias("_of_file"),
        F.col("_split_start").alias("_of_split"),
        "file_name",
        "file_hash",
        "rows_before",
        "file_rows_before",
        "file_batches_before",
    )
    return F.broadcast(offsets) if splits.count() <= BROADCAST_SPLITS else offsets


def numbered_rows(
    scan: DataFrame, offsets: DataFrame, raw_id: int, batch: int, chunk_size: int
) -> DataFrame:
    """The rows of ``scan`` as raw rows, numbered after ``raw_id`` and ``batch``."""
    index = F.col("_split_row") + F.col("rows_before")
    same = (F.col("file_path") == F.col("_of_file")) & (
        F.col("_split_start") == F.col("_of_split")
    )
    return scan.join(offsets, same).select(
        (F.lit(raw_id) + F.col("file_rows_before") + index + 1).alias("raw_id"),
        batch_of(index, chunk_size, F.lit(batch) + F.col("file_batches_before")).alias("batch_no"),
        F.col("file_name").alias("source_file"),
        "file_hash",
        F.current_timestamp().alias("loaded_at"),
        *TRIP_COLUMNS,
    )


def _load(spark, fresh, layouts, warehouse, chunk_size, multi_line) -> dict[str, str]:
    """Loads the files that are sound; the others come back with their reason.

    ``layouts`` has the paths of each header, read together.
    """
    load_id = f"load-{uuid.uuid4().hex}"
    stage = f"{warehouse}/raw/stage/{load_id}"
    chosen = control_rows(
        spark,
        [
            (number, row.path, row.file_path, row.file_name, row.file_hash)
            for number, row in enumerate(fresh)
        ],
        ["file_no", "path", "file_path", "file_name", "file_hash"],
    )

    # 1. Count the rows of every split. The scan that numbers them is split alike.
    work = split_session(spark)
    scans = [read_trip_csv(work, paths, list(c), multi_line) for c, paths in layouts.items()]
    scan = reduce(DataFrame.unionByName, scans)
    counted = scan.groupBy("file_path", "_split_start").agg(
        F.count(F.lit(1)).alias("split_rows"), F.count_if("too_long").alias("too_long")
    )
    lost = F.raise_error(F.concat(F.lit("not among the listed files: "), F.col("file_path")))
    counted.join(chosen, "file_path", "left").select(
        F.coalesce("file_no", lost).alias("file_no"), "_split_start", "split_rows", "too_long"
    ).write.mode("overwrite").parquet(f"{stage}/counts")
    counts = spark.read.parquet(f"{stage}/counts")
    too_long = counts.groupBy("file_no").agg(F.sum("too_long").alias("n")).where("n > 0")
    bad = {r.file_no: r.n for r in too_long.collect()}
    failed = {
        row.path: f"{bad[number]} rows with more fields than the header"
        for number, row in enumerate(fresh)
        if number in bad
    }
    if len(failed) == len(fresh):
        delete_path(spark, stage)
        return failed
    if failed:
        counts, chosen = (df.where(~F.col("file_no").isin(*bad)) for df in (counts, chosen))

    # 2. Rows and batches before each split; one row per split or per file.
    rows_before(counts, "_split_start", "split_rows", group="file_no").write.mode(
        "overwrite"
    ).parquet(f"{stage}/splits")
    splits = spark.read.parquet(f"{stage}/splits")

    last = load_log(spark, warehouse).agg(
        F.coalesce(F.max("last_batch"), F.lit(0)).alias("batch"),
        F.coalesce(F.max("last_raw_id"), F.lit(0)).alias("raw_id"),
    ).first()
    sizes = splits.groupBy("file_no").agg(F.sum("split_rows").alias("row_count"))
    per_file = chosen.join(sizes, "file_no", "left").select(
        chosen["*"], F.coalesce("row_count", F.lit(0)).alias("row_count")
    )
    batches = F.ceil(F.col("row_count") / F.lit(chunk_size)).alias("batches")
    per_file = rows_before(
        per_file.select("*", batches), "file_no", "row_count"
    ).withColumnRenamed("rows_before", "file_rows_before")
    per_file = rows_before(per_file, "file_no", "batches").withColumnRenamed(
        "rows_before", "file_batches_before"
    )
    per_file.write.mode("overwrite").parquet(f"{stage}/files")
    per_file = spark.read.parquet(f"{stage}/files")

    # 3. Number the rows of a second scan and write them, once. Files that failed have no
    #    offsets, so their rows end here.
    totals = per_file.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows")).first()
    offsets = split_offsets(splits, per_file)
    numbered = numbered_rows(scan, offsets, last.raw_id, last.batch, chunk_size)
    written = Observation()
    target = f"{warehouse}/raw/transactions_raw/load_id={load_id}"
    numbered.observe(
        written,
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("raw_id") - last.raw_id).cast("decimal(38,0)")).alias("ids"),
    ).write.mode("overwrite").parquet(target)
    n, seen = totals.rows, written.get  # an empty load may show nothing
    if (seen.get("rows") or 0, int(seen.get("ids") or 0)) != (n, n * (n + 1) // 2):
        delete_path(spark, target)
        delete_path(spark, stage)
        raise OSError("files changed while they were loaded")

    # 4. Commit.
    first_batch = F.lit(last.batch) + F.col("file_batches_before") + 1
    append_small(
        per_file.select(
            F.lit(load_id).alias("load_id"),
            F.col("path").alias("file_path"),
            "file_name",
            "file_hash",
            first_batch.cast("int").alias("first_batch"),
            (first_batch + F.col("batches") - 1).cast("int").alias("last_batch"),
            "row_count",
            (F.lit(last.raw_id) + F.col("file_rows_before") + F.col("row_count")).alias(
                "last_raw_id"
            ),
            F.current_timestamp().alias("loaded_at"),
        ),
        f"{warehouse}/raw/load_log",
    )
    delete_path(spark, stage)
    return failed
