"""Repeated strings of bytes or words, by bucket-pointer refinement over sampled suffixes.

A suffix's bucket at depth h is named by an identifier of its first h bytes. As in
bucket-pointer refinement, suffixes start in buckets of their first few bytes, and
a bucket of depth 2h is the pair (identifier at depth h, identifier at depth h found h
bytes later): each refinement reads the identifiers that the one before it has
updated. Identifiers follow from the bytes alone, as two independent 64-bit mixes,
so equal strings have equal ones in all tasks and no order of all suffixes is built.

Not all suffixes are sorted. Of the starts in each stretch of SIZE bytes, the one whose
bucket at a small depth is least is its anchor; equal strings have equal anchors.
Neighbouring starts share theirs, so there is one row for about 170 bytes:

1. rows are grouped by the anchor's bucket. Alone in its bucket, none of the row's
   strings occurs elsewhere, and the row is done with;
2. they are refined by the bucket of the whole stretch that the row's strings
   cover. Rows that share it are repeated as a whole, and done with but for one,
   which stands for all in what follows;
3. rows left in a bucket with several kinds are cut into blocks of starts, counted
   from the anchor, and the blocks treated like rows: the bytes common to all
   strings of a block name its bucket, the bytes they cover its kind. Blocks
   shrink to a single start.

Bytes and words go the same way: a text is an array of units, and only what names a single
unit, and the lengths, differ (``Kind``). Words count as repeated where they occur in
another document; rows that stand for others then carry which documents they stand
for, as the least and the greatest number.

Texts are written once, bucketed by row number, so that no later join moves them.
Texts of any length are read in chunks; groups are counted by combining aggregates
and joined back from a side that is unique by key, so copies by the thousand are
rows that many tasks share.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh, shared_dir, small_batches, stage
from .word_tokens import pieces
from .worker import release
from .wu_manber import merged

SIZE = 400
#: Words of a string that counts as repeated, in the pipeline's stage: over fifty.
WORDS = 51
#: Units of small texts looked at together, and of a chunk of a long text.
GATHER = 1 << 18
CHUNK = 1 << 19
#: Bytes of texts cut into words at a time.
PIECE = 1 << 20
_PLACE_BITS = 20  # places in a buffer; more than CHUNK and a string
_GAP = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_MIX = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mix(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    x = a * np.uint64(_MIX[lane][0])
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(_MIX[lane][1])
    x ^= x >> np.uint64(29)
    return x


@dataclass(frozen=True)
class Kind:
    """What a unit is, and the lengths in units.

    ``size`` is that of a repeated string. Buckets begin at depth ``gram``; anchors are chosen
    at depth ``anchor``, and stretches, at most ``2 * size - anchor`` long, are named from
    ``probes`` buckets of depth ``depth``, which is at most ``size`` less a block. Texts are
    cut into ``blocks`` of starts, from one cut to the next. ``across``: a string is
    repeated only if another document has it.
    """

    units: Callable[[list[str | None]], list[np.ndarray]]
    initial: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    size: int
    gram: int
    anchor: int
    depth: int
    blocks: tuple[int, ...]
    across: bool
    probes: int = 3


def initial_buckets(raw: np.ndarray, gram: int = 8) -> np.ndarray:
    """The first ``gram`` bytes from each place, as a number."""
    v, have = raw.astype(np.uint64), 1
    while have < gram:
        v = v[:-have] | (v[have:] << np.uint64(8 * have))
        have *= 2
    return v


def byte_units(texts: list[str | None]) -> list[np.ndarray]:
    return [np.frombuffer((text or "").encode(), np.uint8) for text in texts]


def word_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and the bytes that are no white space."""
    word = ~_GAP[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    return np.flatnonzero(begins), word


def word_names(raw: np.ndarray, starts: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Two independent 64-bit names of each word, from its bytes alone."""
    places = np.flatnonzero(word)
    first = np.searchsorted(places, starts)
    size = np.diff(np.append(first, len(places)))
    within = np.arange(len(places)) - np.repeat(first, size)
    value = raw[places].astype(np.uint64) + np.uint64(1)
    out = np.empty((len(starts), 2), np.uint64)
    for lane, (_, base) in enumerate(_MIX):
        powers = np.full(int(size.max()), base, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)  # modulo 2**64
        out[:, lane] = _mix(np.add.reduceat(value * powers[within], first), size.astype(np.uint64), lane)
    return out


def word_units(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's words as rows of two numbers; small texts are cut together."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        raw = np.frombuffer(b"\n".join([*held, b""]), np.uint8)
        starts, word = word_starts(raw)
        names = word_names(raw, starts, word) if len(starts) else np.empty((0, 2), np.uint64)
        ends = np.cumsum([len(x) + 1 for x in held])
        out.extend(np.split(names, np.searchsorted(starts, ends[:-1])))
        held.clear()

    for text in texts:
        raw = (text or "").encode()
        if held and sum(map(len, held)) + len(raw) > PIECE:
            flush()
        if len(raw) > PIECE:
            parts = []
            for piece in pieces(raw, PIECE):
                held.append(piece)
                flush()
                parts.append(out.pop())
            out.append(np.concatenate(parts))
        else:
            held.append(raw)
    if held:
        flush()
    return out


def _bytes_initial(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = initial_buckets(raw)
    return first, first


def _words_initial(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(raw[:, 0]), np.ascontiguousarray(raw[:, 1])


BYTES = Kind(byte_units, _bytes_initial, SIZE, 8, 64, 256, (64, 8, 1), False)


def words_kind(size: int = WORDS) -> Kind:
    """Strings of ``size`` words, 16 at least, that occur in other documents too."""
    if size < 16:
        raise ValueError(f"strings must have at least 16 words, not {size}")
    depth = 1 << ((size - 7).bit_length() - 1)
    probes = max(3, -(-(2 * size - 8) // depth))
    return Kind(word_units, _words_initial, size, 1, 8, depth, (8, 1), True, probes)


def refine(ids: np.ndarray, depth: int, to: int, lane: int) -> np.ndarray:
    """Identifiers at depth ``to`` from those at ``depth``, ``to`` a power times it."""
    while depth < to:
        ids = _mix(ids[:-depth], ids[depth:], lane)
        depth *= 2
    return ids


def least_in_windows(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks."""
    n = len(v) - width + 1
    pad = -len(v) % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretch_ids(
    ids: np.ndarray, depth: int, low: np.ndarray, end: np.ndarray, lane: int, probes: int = 3
) -> np.ndarray:
    """Buckets of units [low, end), ``depth`` to ``probes`` times that long, from those at ``depth``."""
    room = end - depth - low
    x = ids[low]
    for k in range(1, probes):
        x = _mix(x, ids[low + room * k // (probes - 1)], lane)
    return _mix(x, (end - low).astype(np.uint64), lane)


def anchor_rows(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, how: Kind = BYTES):
    """(text, low, high, at, bucket, kind) of texts [begin, end) in ``raw``.

    Strings that start from low to high, both included, share the anchor ``at``.
    """
    size = how.size
    n = len(raw) - size + 1
    whole = ends - begins >= size
    if n <= 0 or not whole.any():
        return None
    first, second = how.initial(raw)
    anchors = refine(first, how.gram, how.anchor, 0)
    places = np.uint64((1 << _PLACE_BITS) - 1)
    marked = (anchors & ~places) | np.arange(len(anchors), dtype=np.uint64)
    chosen = (least_in_windows(marked, size - how.anchor + 1) & places).astype(np.int64)
    mark = np.zeros(len(raw) + 1, np.int64)
    np.add.at(mark, begins[whole], 1)
    np.add.at(mark, ends[whole] - size + 1, -1)
    valid = np.cumsum(mark)[:n] > 0
    new = valid.copy()
    new[1:] &= (chosen[1:] != chosen[:-1]) | ~valid[:-1]
    new[begins[whole]] = True  # a text may begin right where the one before it ended
    low = np.flatnonzero(new)
    high = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
    text = np.searchsorted(begins, low, "right") - 1
    at = chosen[low]
    deep = refine(second, how.gram, how.depth, 1)
    kind = _mix(stretch_ids(deep, how.depth, low, high + size, 1, how.probes), (at - low).astype(np.uint64), 1)
    return text, low - begins[text], high - begins[text], at - begins[text], anchors[at], kind


def block_rows(
    raw: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, block: int, how: Kind = BYTES
):
    """(row, low, high, bucket, kind) of the blocks of starts that rows are cut into.

    Blocks are counted from the row's anchor, so equal strings lie in like blocks.
    The bucket is that of the units which all strings of the block have in common.
    """
    first, last = (low - at) // block, (high - at) // block
    n = last - first + 1
    row = np.repeat(np.arange(len(low)), n)
    index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[row]
    begin = at[row] + index * block
    one, two = how.initial(raw)
    common, deep = refine(one, how.gram, how.depth, 0), refine(two, how.gram, how.depth, 1)
    bucket = stretch_ids(common, how.depth, begin + block - 1, begin + how.size, 0, how.probes)
    bucket = _mix(bucket, np.full(len(row), block, np.uint64), 0)
    a, b = np.maximum(begin, low[row]), np.minimum(begin + block - 1, high[row])
    kind = _mix(stretch_ids(deep, how.depth, a, b + how.size, 1, how.probes), (a - begin).astype(np.uint64), 1)
    return row, a, b, bucket, kind


#: ``lo`` and ``hi``: the documents that a row stands for, where that matters.
_NAMES = ["row", "low", "high", "at", "bucket", "kind", "lo", "hi"]


def _ddl(how: Kind) -> str:
    return ", ".join(f"{name} long" for name in (_NAMES if how.across else _NAMES[:6]))


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    longs = [np.ascontiguousarray(c).view(np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in longs], _NAMES[: len(longs)])


def find_rows(how: Kind):
    """Anchors of rows (row, text), each text whole, for ``mapInArrow``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            n = np.array([len(x[2]) for x in held], np.int64)
            ends = np.cumsum(n)
            found = anchor_rows(np.concatenate([x[2] for x in held]), ends - n, ends, how)
            if found is not None:
                text, low, high, at, *ids = found
                own, off = (np.array([x[k] for x in held], np.int64)[text] for k in (0, 1))
                yield _batch([own, low + off, high + off, at + off, *ids, *([own, own] if how.across else [])])
            held.clear()

        for batch in batches:
            for row, raw in zip(batch[0].to_pylist(), how.units(batch[1].to_pylist()), strict=True):
                for at in range(0, len(raw) - how.size + 1, CHUNK):
                    part = raw[at : at + CHUNK + how.size - 1]
                    if held and size + len(part) > GATHER:
                        yield from flush()
                        size = 0
                    held.append((row, at, part))
                    size += len(part)
        if held:
            yield from flush()

    return find


def cut_blocks(block: int, how: Kind):
    """Blocks of the open rows of (row, text, runs), for ``mapInArrow``."""
    columns = ["low", "high", "at", *(["lo", "hi"] if how.across else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            n = np.array([len(x[2]) for x in held], np.int64)
            shift = np.cumsum(n) - n  # from places in a part to places in the buffer
            m = np.concatenate([x[3] for x in held])
            m[:, :3] += np.repeat([k - x[1] for x, k in zip(held, shift, strict=True)], [len(x[3]) for x in held])[:, None]
            part = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
            pad = np.zeros((how.gram, *held[0][2].shape[1:]), held[0][2].dtype)
            raw = np.concatenate([*(x[2] for x in held), pad])
            row, low, high, *ids = block_rows(raw, m[:, 0], m[:, 1], m[:, 2], block, how)
            own = np.array([x[0] for x in held], np.int64)[part[row]]
            back = (np.array([x[1] for x in held], np.int64) - shift)[part[row]]
            yield _batch([own, low + back, high + back, m[row, 2] + back, *ids, *m[row, 3:].T])
            held.clear()

        for batch in batches:
            texts = how.units(batch[1].to_pylist())
            for row, raw, runs in zip(batch[0].to_pylist(), texts, batch[2], strict=True):
                runs = runs.values  # numbers in arrays: a text may have very many runs
                open_rows = np.stack([runs.field(c).to_numpy() for c in columns], axis=1)
                open_rows = open_rows[np.argsort(open_rows[:, 0], kind="stable")]
                begin = 0
                while begin < len(open_rows):
                    base = int(open_rows[begin, 0])
                    near = open_rows[begin:, 1].searchsorted(base + CHUNK)
                    end = begin + max(1, int(near))
                    # rows of one anchor are at most one string's starts wide
                    part = raw[base : int(open_rows[begin:end, 1].max()) + how.size]
                    if held and size + len(part) > GATHER:
                        yield from flush()
                        size = 0
                    held.append((row, base, part, open_rows[begin:end].copy()))
                    size += len(part)
                    begin = end
        if held:
            yield from flush()

    return cut


def resolve(spark: SparkSession, rows: DataFrame, how: Kind) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): rows repeated as a whole, and rows that a finer cut may split.

    Of rows repeated alike only one stays open, in buckets that hold others too.
    """
    again = F.min("lo") != F.max("hi") if how.across else F.count("*") > 1
    shared = stage(
        spark,
        rows.groupBy(F.col("bucket").alias("b"))
        .agg(again.alias("again"), F.min("kind").alias("one"), F.max("kind").alias("other"))
        .filter("again")
        .select("b", (F.col("one") != F.col("other")).alias("mixed")),
        "shared",
    )
    near = stage(spark, rows.join(shared, rows["bucket"] == shared["b"]).drop("b"), "near")
    mixed = near.filter("mixed")
    stand = F.xxhash64("row", "low")
    ends = [F.min("lo").alias("first"), F.max("hi").alias("last")] if how.across else []
    kinds = stage(
        spark,
        mixed.groupBy(F.col("bucket").alias("b"), F.col("kind").alias("k"))
        .agg(again.alias("again"), F.min(stand).alias("stands"), *ends)
        .filter("again"),
        "kinds",
    )
    docs = [F.coalesce("first", "lo").alias("lo"), F.coalesce("last", "hi").alias("hi")] if how.across else []
    judged = mixed.join(kinds, (mixed["bucket"] == kinds["b"]) & (mixed["kind"] == kinds["k"]), "left").select(
        "row", "low", "high", "at", *docs, F.col("again").alias("whole"), (stand == F.col("stands")).alias("stands")
    )
    judged = stage(spark, judged, "judged")
    repeated = near.filter("not mixed").select("row", "low", "high").union(
        judged.filter("whole").select("row", "low", "high")
    )
    return repeated, judged.filter("whole is null or stands").drop("whole", "stands")


def numbered_texts(spark: SparkSession, documents: DataFrame, row: str) -> DataFrame:
    """``documents`` with row numbers, written in buckets of the number.

    The table's files lie in the shared folder; its name in the catalog is dropped at
    once, as the frame keeps all it needs.
    """
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/texts"
    name = f"hackney_texts_{uuid.uuid4().hex}"
    (
        documents.withColumn(row, F.monotonically_increasing_id())
        .repartition(n, row)
        .write.bucketBy(n, row)
        .option("path", path)
        .option("compression", "zstd")
        .format("parquet")
        .saveAsTable(name)
    )
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return texts


def repeated_runs(spark: SparkSession, texts: DataFrame, row: str = "row", how: Kind = BYTES) -> DataFrame:
    """(row, runs): starts [low, high] of repeated strings, of texts that have any."""
    slim = texts.select(F.col(row).alias("row"), "text")
    repeated, still = resolve(spark, stage(spark, slim.mapInArrow(find_rows(how), _ddl(how)), "anchors"), how)
    for block in how.blocks:
        open_rows = F.struct(*(c for c in still.columns if c != "row"))
        runs = still.groupBy("row").agg(F.collect_list(open_rows).alias("runs"))
        cut = slim.join(runs, "row").select("row", "text", "runs").mapInArrow(cut_blocks(block, how), _ddl(how))
        more, still = resolve(spark, stage(spark, cut, f"blocks-{block}"), how)
        repeated = repeated.union(more)
    return repeated.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("runs"))


def removed(low: np.ndarray | None, high: np.ndarray | None, size: int = SIZE) -> np.ndarray:
    """Maximal removed runs [first, last) of a text, from its runs of starts."""
    if low is None or not len(low):
        return np.empty((0, 2), np.int64)
    return merged(np.stack([low, np.asarray(high) + size], axis=1).astype(np.int64))


def kept_parts(raw: bytes, gone: np.ndarray) -> Iterator[bytes]:
    at = 0
    for first, last in gone.tolist():
        yield raw[at:first]
        at = last
    yield raw[at:]


def op3(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Null and short texts lose nothing. Repeated rows repeat each other, and lose all
    their strings. An empty table gives no rows. Other columns are not read.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows = []
            for text, low, high in zip(batch[1], batch[2], batch[3], strict=True):
                raw = (text.as_py() or "").encode()
                # Numbers in one array: a text may have very many runs.
                gone = removed(*(x.values and x.values.to_numpy() for x in (low, high)))
                kept = hashlib.sha256()
                for part in kept_parts(raw, gone):
                    kept.update(part)
                lost = int((gone[:, 1] - gone[:, 0]).sum())
                rows.append((len(raw), lost, len(gone), kept.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch[0], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = numbered_texts(spark, slim, "row")
    return (
        texts.join(repeated_runs(spark, texts), "row", "left")
        .select("doc_id", "text", "runs.low", "runs.high")
        .mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def without_words(text: str, runs: np.ndarray) -> str:
    """``text`` without its words [first, last) of each run, nor the white space after them."""
    raw = text.encode()
    # first bytes of words stand as they are, so cuts never fall into a character
    starts, _ = word_starts(np.frombuffer(raw, np.uint8))
    starts = np.append(starts, len(raw))
    return b"".join(kept_parts(raw, starts[runs])).decode()


def without_repeats(spark: SparkSession, documents: DataFrame, words: int = WORDS) -> DataFrame:
    """``documents``, all rows and columns, without passages that other documents have too.

    A passage is a string of ``words`` words, whatever white space is between them; each word
    in one that occurs in two or more rows is cut in all of them, with the white space
    after it. What a text repeats in itself alone stays. Repeated rows are different
    rows here, and lose what they share. Null texts stay null; empty texts, and texts
    of fewer words, stay as they are. ``n_chars``, where there is one, is the new
    length. An empty table gives no rows.
    """

    @F.pandas_udf("string")
    def rest(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        release()
        out = []
        for text, low, high in zip(texts, lows, highs, strict=True):
            gone = removed(low, high, words)
            out.append(without_words(text, gone) if text is not None and len(gone) else text)
        return pd.Series(out, dtype=object)

    row = fresh(documents, "row")
    texts = numbered_texts(spark, documents, row)
    runs = repeated_runs(spark, texts, row, words_kind(words))
    own, found = fresh(documents, "of"), fresh(documents, "runs")
    joined = texts.join(runs.toDF(own, found), F.col(row) == F.col(own), "left")
    joined = joined.withColumn("text", rest("text", f"{found}.low", f"{found}.high"))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return joined.select(*(f"`{c}`" for c in documents.columns))
