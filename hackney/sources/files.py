"""Finding CSV files and fingerprinting their content."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hackney.sources.storage import control_rows, literal, no_rows

# Lines a batch when files are hashed.
LINES = 10_000
# The byte order mark of UTF-8.
MARK = b"\xef\xbb\xbf"
# A first line longer than this is no header.
HEADER_BYTES = 1024**2

FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("length", T.LongType()),
        # Microseconds of the epoch.
        T.StructField("modified", T.LongType()),
    ]
)
# What a file was when its content was read; ``settled`` if the time of change tells it from
# whatever it may become later.
FILE_STATE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modified", T.LongType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("header", T.StringType()),
        T.StructField("settled", T.BooleanType()),
    ]
)


def base_name(path: Column) -> Column:
    # Not the metadata's file_name, which is percent-encoded.
    return F.substring_index(path, "/", -1)


def base_name_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def listed(files: DataFrame) -> DataFrame:
    """The listing columns of a ``binaryFile`` frame; names and states only, no content."""
    return files.select(
        "path",
        F.col("_metadata.file_path").alias("file_path"),
        base_name(F.col("path")).alias("file_name"),
        "length",
        F.unix_micros("modificationTime").alias("modified"),
    )


def _listing(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return listed(spark.read.format("binaryFile").options(**options).load(path))


def discover_csv(spark: SparkSession, prefix: str) -> DataFrame:
    """CSV files anywhere below ``prefix``, suffix in any case; empty ones aside."""
    try:
        return _listing(
            spark, literal(prefix), pathGlobFilter="*.[cC][sS][vV]", recursiveFileLookup="true"
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_rows(spark, FILE)


def single_file(spark: SparkSession, path: str) -> DataFrame:
    """One explicit file, whatever its suffix."""
    return _listing(spark, literal(path))


def known_states(files: DataFrame, states: DataFrame) -> DataFrame:
    """``files`` with the ``file_hash`` and ``header`` of the same path, length and time, if known."""
    same = ["path", "length", "modified"]
    return files.join(states.where("settled").dropDuplicates(same), same, "left").select(
        *FILE.names, "file_hash", "header"
    )


def rewritten(files: DataFrame, states: DataFrame) -> DataFrame:
    """Files whose path is known, but not for sure with this length and time."""
    paths = states.select("path").distinct()
    same = states.where("settled").select("path", "length", "modified")
    return files.join(paths, "path", "left_semi").join(
        same, ["path", "length", "modified"], "left_anti"
    )


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_path, file_hash, header) of files whose lines come in order, whole files only.

    Lines lack their ends, and the reader leaves out a byte order mark. The length of the
    file tells whether there was a mark, and whether the last line had an end; as it
    is checked at the end, one digest begins with the mark and one without.
    """
    path = header = None
    length = read = 0
    digests: list = []

    def found() -> pa.RecordBatch:
        # Each line was counted with an end.
        marked = length - read in (len(MARK), len(MARK) - 1)
        ended = length - read in (len(MARK), 0)
        if not marked and not ended and length - read != -1:
            raise OSError(f"{path}: {length} bytes listed, {read} read")
        digest = digests[marked]
        if ended:
            digest.update(b"\n")
        row = {"file_path": path, "file_hash": digest.hexdigest(), "header": header}
        return pa.RecordBatch.from_pylist([row])

    for batch in batches:
        names = batch.column("file_path")
        # A run of lines of one file at a time.
        bounds = pc.run_end_encode(names)
        start = 0
        for end, name in zip(bounds.run_ends.to_pylist(), bounds.values.to_pylist(), strict=True):
            lines = batch.column("line").slice(start, end - start).to_pylist()
            data = b"\n".join(lines)
            if name != path:
                if path is not None:
                    yield found()
                path, read, length = name, 0, batch.column("length")[start].as_py()
                header = lines[0][:HEADER_BYTES].decode(errors="replace")
                digests = [hashlib.sha256(), hashlib.sha256(MARK)]
            else:
                data = b"\n" + data
            for digest in digests:
                digest.update(data)
            read += sum(map(len, lines)) + len(lines)
            start = end
    if path is not None:
        yield found()


def fingerprint(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``files`` plus ``file_hash``, the SHA-256 of the whole content, and ``header``.

    ``files`` is the materialised listing (paths and sizes, no content). Files of every
    size and scheme are read by Spark's own line reader, each by one task that holds one
    batch of lines. A listed file that cannot be read back is an error, never a file less.
    """
    listing = files.select("path", "length").collect()
    if not listing:
        return files.withColumns({c: F.lit(None).cast("string") for c in ("file_hash", "header")})
    # In a session of its own, where no file is split: neither the cap nor the cost of
    # opening a file, which is the least size of a split, is below the longest file.
    whole = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if not name.startswith("spark."):  # what a file system may need
            whole.conf.set(name, value)
    longest = str(max(row.length for row in listing) + 1)
    whole.conf.set("spark.sql.files.maxPartitionBytes", longest)
    whole.conf.set("spark.sql.files.openCostInBytes", longest)
    whole.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", LINES)
    lines = whole.read.option("lineSep", "\n").text([literal(row.path) for row in listing])
    hashes = (
        lines.select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("length"),
            F.col("value").cast("binary").alias("line"),
        )
        .mapInArrow(_hash_lines, "file_path string, file_hash string, header string")
        .collect()
    )
    known = control_rows(spark, hashes, ["_file_path", "file_hash", "header"]) if hashes else None
    if known is None:
        known = no_rows(spark, FILE).selectExpr("path AS _file_path", "path AS file_hash", "path AS header")
    # A file that is a byte order mark and nothing else has no line.
    bare = F.when(F.col("length") == len(MARK), F.lit(hashlib.sha256(MARK).hexdigest()))
    unread = F.raise_error(F.concat(F.lit("listed, but not read: "), F.col("path")))
    return files.join(known, F.col("file_path") == F.col("_file_path"), "left").select(
        *files.columns, F.coalesce("file_hash", bare, unread).alias("file_hash"), "header"
    )
