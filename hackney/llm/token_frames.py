"""Token ids in binary shards: independent zstandard frames and a seek table.

A shard file holds, one after another:

* zstandard frames, each decompressible alone, with a content checksum. Their
  contents, joined, are the documents' ids as little-endian unsigned 32-bit
  integers. Frames end at document ends; only a document longer than a frame
  spans several, so writer and reader hold one frame at a time;
* a skippable frame with the document index (zstandard): for each document its id,
  whether the id is null, and its number of ids;
* a skippable frame with the seek table: compressed size, decompressed size and
  checksum (low half of XXH64 of the contents) of each frame, in the layout of the
  public "seekable format" of zstandard.

Any zstandard tool decompresses the file, a reader of the seekable format can seek
in it, and :func:`fetch` decompresses only the frames that hold wanted documents.

Shards are written by tasks under a name of their own attempt. The manifest, written
by Spark, names the shards of the attempts that were committed; files of lost or
doubled attempts are named nowhere and never read.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import word_tokens
from .scratch import shared_dir, small_batches

#: Fixed values of the public seekable format.
SEEK_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
FOOTER_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

#: Ids in a frame; a frame ends with the first document that reaches this many.
FRAME_IDS = 64 * 1024
END_ID = 1
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long"


class ShardWriter:
    """Writes one shard to an open binary file."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self._out, self._frame_ids, self._level = out, frame_ids, level
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._open: list[np.ndarray] = []
        self._in_frame = 0
        self._frames: list[tuple[int, int, int]] = []
        self._docs: list[int | None] = []
        self._lengths: list[int] = []
        self.n_tokens = self.n_bytes = 0

    @property
    def n_docs(self) -> int:
        return len(self._docs)

    def add(self, doc_id: int | None, ids: Iterable[np.ndarray]) -> None:
        n = 0
        for part in ids:
            n += len(part)
            for at in range(0, len(part), self._frame_ids):
                cut = part[at : at + self._frame_ids]
                self._open.append(cut)
                self._in_frame += len(cut)
                if self._in_frame >= 4 * self._frame_ids:  # within a long document
                    self._flush()
        self._docs.append(doc_id)
        self._lengths.append(n)
        self.n_tokens += n
        if self._in_frame >= self._frame_ids:
            self._flush()

    def _put(self, data: bytes) -> int:
        self._out.write(data)
        self.n_bytes += len(data)
        return len(data)

    def _flush(self) -> None:
        import xxhash

        if self._open:
            raw = np.concatenate(self._open).astype("<u4", copy=False).tobytes()
            size = self._put(self._zstd.compress(raw))
            self._frames.append((size, len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self._open, self._in_frame = [], 0

    def close(self) -> None:
        self._flush()
        ids = np.array([d or 0 for d in self._docs], "<i8").tobytes()
        null = np.array([d is None for d in self._docs], np.uint8).tobytes()
        index = self._zstd.compress(ids + null + np.array(self._lengths, "<i8").tobytes())
        self._put(struct.pack("<II", INDEX_MAGIC, len(index) + 8) + index + struct.pack("<Q", len(self._docs)))
        table = b"".join(struct.pack("<III", *f) for f in self._frames)
        footer = struct.pack("<IBI", len(self._frames), WITH_CHECKSUMS, FOOTER_MAGIC)
        self._put(struct.pack("<II", SEEK_MAGIC, len(table) + len(footer)) + table + footer)


@dataclass
class Shard:
    """An open shard: index and seek table read, frames on demand."""

    file: object
    size: int
    doc_ids: list[int | None] = field(default_factory=list)
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def __post_init__(self) -> None:
        import zstandard

        self._zstd = zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(self.size - 9, 9))
        if magic != FOOTER_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the shard")
        seek_at = self.size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(seek_at + 8, 12 * n), "<u4").reshape(n, 3)
        at = self.frames[:, 0].astype(np.int64)
        self.frame_at = np.concatenate([[0], np.cumsum(at)])
        self.frame_ids = np.concatenate([[0], np.cumsum(self.frames[:, 1].astype(np.int64) // 4)])
        index_at = int(self.frame_at[-1])
        body = self._at(index_at + 8, seek_at - index_at - 8)
        (docs,) = struct.unpack("<Q", body[-8:])
        raw = self._zstd.decompress(body[:-8], max_output_size=17 * docs) if docs else b""
        ids = np.frombuffer(raw[: 8 * docs], "<i8").tolist()
        null = raw[8 * docs : 9 * docs]
        self.doc_ids = [None if z else d for d, z in zip(ids, null, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(raw[9 * docs :], "<i8"))]).astype(np.int64)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        data = self._at(int(self.frame_at[k]), int(self.frames[k, 0]))
        raw = self._zstd.decompress(data, max_output_size=int(self.frames[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.frames[k, 2]):
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, "<u4")

    def parts(self, k: int) -> Iterator[np.ndarray]:
        """Ids of the k-th document, frame by frame; only its own frames are read."""
        at, end = int(self.starts[k]), int(self.starts[k + 1])
        if at == end:
            return
        first = int(np.searchsorted(self.frame_ids, at, "right")) - 1
        while at < end:
            if getattr(self, "_held", (None,))[0] != first:
                self._held = (first, self.frame(first))
            base = int(self.frame_ids[first])
            stop = min(end, int(self.frame_ids[first + 1]))
            yield self._held[1][at - base : stop - base]
            at, first = stop, first + 1


def _open_input(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return Shard(store.open_input_file(inner), store.get_file_info(inner).size)


def fetch(path: str, doc_ids: Iterable[int | None]) -> list[tuple[int | None, np.ndarray]]:
    """The wanted documents of one shard; repeated ids give every such document."""
    wanted, shard = set(doc_ids), _open_input(path)
    empty = np.empty(0, np.uint32)
    return [
        (d, np.concatenate([empty, *shard.parts(k)]).astype(np.uint32))
        for k, d in enumerate(shard.doc_ids)
        if d in wanted
    ]


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    frame_ids: int = FRAME_IDS,
) -> DataFrame:
    """Writes ``documents`` (doc_id, text) to shards below ``path``; the manifest.

    Shards follow each other in ascending doc_id, null ids first, one for each
    range partition; their number follows ``spark.sql.shuffle.partitions``. A null
    text counts as empty and gives the end id alone. Repeated rows and ids are all
    written. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or word_tokens.default_path()
    shards = f"{path}/shards"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task, words, end = TaskContext.get(), word_tokens.shared(tokenizer), np.array([end_id], np.uint32)
        store, inner = fs.FileSystem.from_uri(shards)
        store.create_dir(inner, recursive=True)
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.zst"
        writer = None
        for batch in batches:
            texts = (text.as_py() for text in batch[1])
            for doc_id, ids in zip(batch[0].to_pylist(), words.encode_all(texts), strict=True):
                if writer is None:
                    out = store.open_output_stream(posixpath.join(inner, name), compression=None)
                    writer = ShardWriter(out, frame_ids)
                writer.add(doc_id, _with_end(ids, end))
        if writer is not None:
            writer.close()
            out.close()
            row = [task.partitionId(), f"{shards}/{name}", writer.n_docs, writer.n_tokens, writer.n_bytes]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                ["shard", "path", "n_docs", "n_tokens", "n_bytes"],
            )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(write, MANIFEST)
        .write.parquet(f"{path}/manifest")
    )
    return read_manifest(spark, path)


def _with_end(ids: Iterable[np.ndarray], end: np.ndarray) -> Iterator[np.ndarray]:
    yield from ids
    yield end


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """A row for each document of the shards: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. The one window of the
    manifest has a row for each shard. Each shard is read by one task, frame by
    frame, and every checksum is verified.
    """
    n = max(1, manifest.count())
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select(
        "shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _open_input(row["path"])
                for lo in range(0, len(shard.doc_ids), 4096):
                    hi, crcs = min(lo + 4096, len(shard.doc_ids)), []
                    for k in range(lo, hi):
                        crc = 0
                        for part in shard.parts(k):
                            crc = zlib.crc32(part.tobytes(), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[lo:hi], pa.int64()),
                            pa.array(shard.starts[lo:hi] + row["before"]),
                            pa.array(np.diff(shard.starts[lo : hi + 1])),
                            pa.array(crcs, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return shards.repartition(n, "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op1(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Encodes, writes and reads back every whole text."""
    return read_digests(write_tokens(documents, shared_dir(spark)))
